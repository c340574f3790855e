"""Rules, and the fan-out of one event to a branch per rule that fits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, object_json, plain_json, string_json
from ..functions.identity import branch_key, input_hash_column, instance_key, partition_cell_key
from ..functions.scalars import is_blank, iso, not_blank, utf16
from .policy import Limits, Policy


@dataclass(frozen=True)
class Rule:
    """matches, correlation_key, order_key: SQL or Columns over an event row. decide: see outcomes (a function of a batch)."""

    id: str
    version: str
    channel: str
    policy: Policy
    matches: str = "true"
    correlation_key: str = "'default'"
    order_key: str | None = None
    mode: str = "active"
    phase: str | None = None
    decide: Callable | None = None
    prepare: Callable | None = None

    def __post_init__(self):
        if is_blank(self.id) or is_blank(self.version) or self.mode not in ("active", "shadow") or (self.phase is not None and is_blank(self.phase)):
            raise ValueError(f"bad rule {self.id!r}")
        if self.decide is not None and self.prepare is not None:
            raise ValueError("a rule has either decide or prepare")

    def decider(self):
        """The Python function of a batch view, if there is one: decide, or prepare, which gets the frozen batch itself."""
        if self.prepare is not None:
            return lambda view: self.prepare(view.batch)
        return self.decide if callable(self.decide) else None


class Rules:
    """A registry; (id, version) is unique."""

    def __init__(self, rules: list[Rule]):
        self.all = list(rules)
        self.by = {(r.id, r.version): r for r in self.all}
        if len(self.by) != len(self.all):
            raise ValueError("a rule's id and version must be unique")

    def get(self, monitor: str, version: str) -> Rule:
        if (monitor, version) not in self.by:
            raise KeyError(f"no rule {monitor} {version}")
        return self.by[monitor, version]


#: Columns of an event that are keys, and what a plan holds as canonical text.
KEYS = ("event_key", "occurrence_key", "input_hash")
PLANNED = ("__monitor_id", "__definition_version", "__phase", "__mode")


def _plan(rule: Rule) -> Column:
    order = F.expr(rule.order_key) if rule.order_key else F.coalesce(iso(F.col("occurred_ms")), F.col("id"))
    return F.struct(
        (F.coalesce(F.expr(rule.matches), F.lit(False)) & (F.col("channel_id") == rule.channel)).alias("matched"), F.lit(rule.id).alias("monitor_id"), F.lit(rule.version).alias("definition_version"),
        F.lit(rule.phase).cast("string").alias("phase"), F.expr(rule.correlation_key).cast("string").alias("correlation_key"), order.cast("string").alias("order_key"), F.lit(rule.mode).alias("mode"),
        F.lit(canonical_json(rule.policy.value())).alias("policy_json"), F.lit(rule.policy.max_bytes).cast("bigint").alias("max_bytes"),
        *[F.lit(None if x is None else canonical_json(x)).cast("string").alias(f"__{c}") for c, x in {"monitor_id": rule.id, "definition_version": rule.version, "phase": rule.phase, "mode": rule.mode}.items()],
    )


def _logical(made: bool = False) -> dict[str, Column]:
    """What a branch's hash is of: JSON name -> canonical text. made: by fan_out, where keys need no escapes and a plan holds its own texts."""
    text = {
        "applicationId": "application_id", "tenantId": "tenant_id", "partitionKey": "partition_key", "eventKey": "event_key", "occurrenceKey": "occurrence_key", "sourceInputHash": "input_hash",
        "monitorId": "monitor_id", "definitionVersion": "definition_version", "phase": "phase", "correlationKey": "correlation_key", "orderKey": "order_key", "mode": "mode",
    }
    texts = {k: F.col(f"__{c}") if made and f"__{c}" in PLANNED else plain_json(F.col(c)) if made and c in KEYS else string_json(F.col(c)) for k, c in text.items()}
    return texts | {"canonicalizationVersion": F.col("canonicalization_version").cast("string"), "event": F.col("event_json"), "policy": F.col("policy_json")}


def fan_out(events: DataFrame, rules: Rules) -> DataFrame:
    """One row per event and rule that fits, with branch_key, instance_key, branch_hash, bytes and problem (null if sound).

    One scan: the rules' predicates are first a disjunction that can reach the source, then an array that is exploded.
    Order of declaration has no effect.
    """
    if not rules.all:
        raise ValueError("no rules")
    some = reduce(lambda a, b: a | b, [F.expr(r.matches) & (F.col("channel_id") == r.channel) for r in rules.all])
    plans = F.filter(F.array(*map(_plan, rules.all)), lambda p: p["matched"])
    df = events.where(some).withColumn("p", F.explode(plans)).select("*", *[F.col(f"p.{c}").alias(c) for c in ("monitor_id", "definition_version", "phase", "correlation_key", "order_key", "mode", "policy_json", "max_bytes", *PLANNED)]).drop("p")
    cell = partition_cell_key(*[F.col(c) for c in ("application_id", "tenant_id", "channel_id", "installation_id", "partition_key")])
    df = df.withColumn("branch_key", branch_key(*[F.col(c) for c in ("occurrence_key", "monitor_id", "definition_version", "phase", "correlation_key")]))
    df = df.withColumn("__cell", cell).withColumn("instance_key", instance_key(F.col("__cell"), F.col("monitor_id"), F.col("definition_version"), F.col("correlation_key")))
    df = df.withColumn("__text", object_json(_logical(made=True))).withColumn("branch_hash", input_hash_column(F.col("__text")))
    # the whole branch also holds its key and hash: two more fields, each with a comma
    own = object_json({"branchKey": plain_json(F.col("branch_key")), "inputHash": plain_json(F.col("branch_hash"))})
    df = df.withColumn("bytes", (F.octet_length("__text") + F.octet_length(own) - 1).cast("bigint"))
    problem = F.when(~not_blank(F.col("correlation_key")), "blank correlation key").when(~not_blank(F.col("order_key")), "blank order key").when(F.col("bytes") > F.col("max_bytes"), "branch exceeds maxBytes")
    return df.withColumn("problem", problem).drop("max_bytes", "__cell", "__text", *PLANNED)


def receipts(events: DataFrame, branches: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per event, zero matches included: event_key, branch_keys (sorted), streams, bytes, problem (caps, or a branch's)."""
    per = branches.groupBy("event_key").agg(
        F.array_sort(F.collect_list("branch_key")).alias("branch_keys"), F.countDistinct("instance_key").alias("streams"), F.sum("bytes").alias("fanout_bytes"), F.first("problem", ignorenulls=True).alias("__p")
    )
    df = events.select("event_key", "accepted_ms").join(per, "event_key", "left")
    n = F.size(F.coalesce("branch_keys", F.array().cast("array<string>")))
    problem = F.when(n > limits.max_branches, "too many branches").when(F.col("fanout_bytes") > limits.max_fanout_bytes, "fan-out too large").otherwise(F.col("__p"))
    duplicate = F.size(F.array_distinct("branch_keys")) != F.size("branch_keys")
    return df.select(
        "event_key", "accepted_ms", F.coalesce("branch_keys", F.array().cast("array<string>")).alias("branch_keys"), F.coalesce("streams", F.lit(0)).alias("streams"),
        F.coalesce("fanout_bytes", F.lit(0)).alias("fanout_bytes"), F.when(duplicate, "duplicate branch keys").otherwise(problem).alias("problem"),
    )


def stream_appends(branches: DataFrame) -> DataFrame:
    """Branches of one event for one stream: instance_key, event_key, branch_keys (sorted), append_hash, policies (must be 1)."""
    b = F.array_sort(F.collect_list("branch_key"))
    df = branches.groupBy("instance_key", "event_key").agg(b.alias("branch_keys"), F.countDistinct("mode", "policy_json").alias("policies"), F.max("accepted_ms").alias("accepted_ms"))
    text = object_json({"branches": F.to_json("branch_keys"), "eventKey": string_json(F.col("event_key")), "streamKey": string_json(F.col("instance_key"))})
    return df.withColumn("append_hash", input_hash_column(text))


def verify_fanout(branches: DataFrame) -> DataFrame:
    """branch_key, fault: rows whose keys do not follow from their fields. Empty for what fan_out made."""
    good = branch_key(*[F.col(c) for c in ("occurrence_key", "monitor_id", "definition_version", "phase", "correlation_key")])
    cell = partition_cell_key(*[F.col(c) for c in ("application_id", "tenant_id", "channel_id", "installation_id", "partition_key")])
    inst = instance_key(cell, F.col("monitor_id"), F.col("definition_version"), F.col("correlation_key"))
    fault = F.when(good != F.col("branch_key"), "branch key").when(inst != F.col("instance_key"), "instance key")
    return branches.select("branch_key", fault.alias("fault")).where("fault is not null")


def verify_handoff(branches: DataFrame, append_hashes: DataFrame | None = None) -> DataFrame:
    """branch_key, fault: rows whose content does not have the hash they carry, or, with append_hashes (of stream_appends at the sender), whose append is another."""
    fault = F.when(input_hash_column(object_json(_logical())) != F.col("branch_hash"), "branch hash")
    if append_hashes is None:
        return branches.select("branch_key", fault.alias("fault")).where("fault is not null")
    sent = append_hashes.select("instance_key", "event_key", F.col("append_hash").alias("__sent"))
    got = stream_appends(branches).select("instance_key", "event_key", "append_hash")
    odd = got.join(sent, ["instance_key", "event_key"], "left").where(~F.col("append_hash").eqNullSafe(F.col("__sent"))).select("instance_key", "event_key", F.lit(True).alias("__odd"))
    df = branches.join(odd, ["instance_key", "event_key"], "left")
    return df.select("branch_key", F.coalesce(fault, F.when(F.col("__odd"), "append hash")).alias("fault")).where("fault is not null")


def batch_order() -> Column:
    """Sort key of branches within a batch: order key in UTF-16 code units, then event key, then branch key."""
    return F.struct(utf16(F.col("order_key")).alias("o"), "event_key", "branch_key")
