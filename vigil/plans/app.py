"""An application: channels, rules and routes, run over bounded frames or over streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import direct_key, key
from ..functions.scalars import is_blank
from ..operators.channel import Channel
from ..operators.policy import Limits
from ..operators.rules import Rule, Rules, fan_out, receipts
from .batches import keyed, replay, spread
from .wakes import decided, runs


@dataclass(frozen=True)
class Route:
    """deliver: wake (a dict) -> any JSON value; it may be called again with the same bytes and must be idempotent by wakeKey."""

    id: str
    deliver: Callable | None = None


def config_key(application_id: str, channels: dict[str, int], rules: list[Rule], routes: list[str], limits: Limits) -> str:
    """Fingerprint of what decides a stream's state: channels (name -> version), rules with their policies and expressions, routes and limits."""
    own = [
        {"id": r.id, "version": r.version, "channel": r.channel, "policy": r.policy.value(), "matches": r.matches, "correlation": r.correlation_key, "order": r.order_key, "mode": r.mode, "phase": r.phase}
        for r in sorted(rules, key=lambda r: (r.id, r.version))
    ]
    return key("config", application_id, sorted(map(list, channels.items())), own, sorted(routes), asdict(limits))


class App:
    def __init__(self, application_id: str, channels: list[Channel], rules: list[Rule], routes: list[Route], limits: Limits = Limits()):  # noqa: B008
        if is_blank(application_id) or not rules or not channels:
            raise ValueError("an application has an id, channels and rules")
        self.id, self.limits, self.rules = application_id, limits, Rules(rules)
        self.channels = {c.name: c for c in channels}
        self.routes = {r.id: r for r in routes}
        if len(self.channels) != len(channels) or len(self.routes) != len(routes) or any(map(is_blank, [*self.channels, *self.routes])):
            raise ValueError("channels and routes need distinct ids")
        if missing := {r.channel for r in rules} - set(self.channels):
            raise ValueError(f"rules of unknown channels: {sorted(missing)}")

    def config_key(self) -> str:
        return config_key(self.id, {c.name: c.version for c in self.channels.values()}, self.rules.all, list(self.routes), self.limits)

    def checkpoint(self, base: str) -> str:
        """The checkpoint folder of this configuration: a changed one begins anew beside the old."""
        return f"{base.rstrip('/')}/{self.config_key().rsplit(':', 1)[-1]}"

    def events(self, raw: dict[str, DataFrame], accepted_ms: Column | None = None) -> DataFrame:
        """Accepted events of all given channels (name -> raw rows); those that fail validation are in rejects()."""
        out = None
        for name, df in raw.items():
            part = self.channels[name].events(df, self.id, accepted_ms)
            out = part if out is None else out.unionByName(part)
        return out

    def rejects(self, raw: dict[str, DataFrame]) -> DataFrame:
        out = None
        for name, df in raw.items():
            part = self.channels[name].rejects(df, self.id).withColumn("channel_id", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out

    def admitted(self, events: DataFrame) -> DataFrame:
        """Branches of events within the fan-out caps; an event whose fan-out is faulty or too large is left out whole (see receipts)."""
        branches = fan_out(events, self.rules)
        bad = receipts(events, branches, self.limits).where("problem is not null").select("event_key", F.lit(True).alias("__bad"))
        return branches.join(bad, "event_key", "left").where("__bad is null").drop("__bad")

    def folded(self, raw: dict[str, DataFrame], unique: bool = False, capped: bool = False) -> DataFrame:
        """Batches, duplicates and conflicts of a bounded input, in virtual time. capped: check the fan-out caps, which costs a shuffle."""
        events = self.events({name: spread(df) for name, df in raw.items()})
        branches = self.admitted(events) if capped else fan_out(events, self.rules)
        return replay(branches, self.rules, list(self.routes), self.limits, unique)

    def batches(self, raw: dict[str, DataFrame], unique: bool = False) -> DataFrame:
        return decided(keyed(self.folded(raw, unique)), self.rules, list(self.routes))

    def runs(self, raw: dict[str, DataFrame], unique: bool = False) -> DataFrame:
        return runs(self.batches(raw, unique), self.limits)

    def direct(self, raw: dict[str, DataFrame], matches: str, generation: str) -> DataFrame:
        """Direct requests (beside the rules): events that fit, each with a key of its occurrence and the binding's generation."""
        if is_blank(generation):
            raise ValueError("a binding generation must not be blank")
        df = self.events(raw).where(F.expr(matches))
        return df.select("application_id", "tenant_id", "event_key", "occurrence_key", direct_key(F.col("occurrence_key"), F.lit(generation)).alias("direct_key"), "event_json")
