"""Decisions over a frozen batch: Python functions of a batch view, or declarative SQL over a batch row."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..functions.identity import CallbackError
from ..functions.scalars import is_blank
from .mailbox import Buffer


class BatchView:
    """What a decision sees: the ordered events, the last of them, their keys. An empty batch is an error."""

    def __init__(self, batch: Buffer, **about):
        if not batch.branches:
            raise ValueError("a batch is never empty")
        self.batch, self.about = batch, about

    @cached_property
    def events(self) -> list:
        return [json.loads(b.body) if isinstance(b.body, str) else b.body for b in self.batch.branches]

    @property
    def latest(self):
        return self.events[-1]

    @property
    def event_keys(self) -> list[str]:
        return list(dict.fromkeys(b.event_key for b in self.batch.branches))

    def __len__(self) -> int:
        return len(self.batch.branches)


def ignore(decision=None) -> dict:
    return {"kind": "ignore", "decision": decision}


def wake(target, instruction: str, route_id: str | None = None, decision=None, evidence=None) -> dict:
    """A wake; without a route id it goes to the only route there is."""
    return {"kind": "wake", "routeId": route_id, "target": target, "instruction": instruction, "decision": decision, "evidence": evidence}


FIELDS = {"ignore": {"kind", "decision"}, "wake": {"kind", "routeId", "target", "instruction", "decision", "evidence"}}


def checked(outcome, routes: list[str]) -> dict:
    """An outcome within its contract and with its route, or CallbackError."""
    if not isinstance(outcome, dict) or outcome.get("kind") not in FIELDS or set(outcome) != FIELDS[outcome["kind"]]:
        raise CallbackError("a decision returns what ignore() or wake() made")
    try:
        canonical_json(outcome)
    except (TypeError, ValueError) as e:
        raise CallbackError(f"an outcome holds canonical JSON only: {e}") from e
    if outcome["kind"] == "ignore":
        return outcome
    route = outcome["routeId"]
    if route is None:
        if len(routes) != 1:
            raise CallbackError("a wake names its route unless exactly one is registered")
        route = routes[0]
    if is_blank(route) or is_blank(outcome["instruction"]):
        raise CallbackError("route and instruction must not be blank")
    return outcome | {"routeId": route}


@dataclass(frozen=True)
class Decision:
    """A declarative decision: SQL over a batch row (instance_key, correlation_key, n, bytes, opened_ms, frozen_ms, closed_by, events).

    events is the ordered array of (event_key, id, type, occurred_ms, data). target, decision and evidence are SQL for JSON text.
    """

    when: str
    instruction: str
    target: str
    route_id: str | None = None
    decision: str = "'null'"
    evidence: str = "'null'"

    def columns(self, routes: list[str]) -> dict:
        route = self.route_id
        if route is None:
            if len(routes) != 1:
                raise ValueError("a decision names its route unless exactly one is registered")
            route = routes[0]
        if is_blank(self.instruction) or is_blank(route):
            raise ValueError("route and instruction must not be blank")
        hit = F.coalesce(F.expr(self.when), F.lit(False))
        only = lambda c: F.when(hit, c)
        return {
            "kind": F.when(hit, "wake").otherwise("ignore"), "route_id": only(F.lit(route)), "target": only(F.expr(self.target)), "instruction": only(F.lit(self.instruction)),
            "decision": F.expr(self.decision), "evidence": only(F.expr(self.evidence)),
        }


def sequence(first: Callable, then: Callable, outcome: Callable) -> Callable:
    """A decision that wakes if an event fits `first` and a later one fits `then`: outcome(batch, a, b); else it ignores."""

    def decide(batch: BatchView) -> dict:
        a = next((i for i, e in enumerate(batch.events) if first(e)), None)
        b = None if a is None else next((e for e in batch.events[a + 1 :] if then(e)), None)
        return ignore() if b is None else outcome(batch, batch.events[a], b)

    return decide


#: The same as SQL over the types of a batch's events, for Decision.when.
def sequence_sql(first: str, then: str) -> str:
    at = f"array_position(events.type, '{first}')"
    return f"{at} > 0 AND array_position(slice(events.type, int({at}) + 1, greatest(size(events) - int({at}), 0)), '{then}') > 0"
