"""The state machine of one stream: dedup, buffering, freezing, cooldown and the life of a run.

Pure Python without a clock; times are integer milliseconds. Replay, the poll engine and the streaming runner drive the same
class, so that they cannot differ in what a batch is.
"""

from __future__ import annotations

from collections import deque
from dataclasses import asdict, dataclass, field

from ..functions.identity import assert_same_input
from .policy import Limits, Policy


@dataclass(slots=True)
class Branch:
    """One event that one rule selected. body: what a decision sees of it (canonical text of the event, or any value)."""

    key: str
    hash: str
    event_key: str
    order_key: str
    bytes: int
    body: str | None = None

    def rank(self) -> tuple:
        """Order within a batch: UTF-16 code units of the order key, then the keys."""
        return self.order_key.encode("utf-16-be", "surrogatepass"), self.event_key, self.key


@dataclass(slots=True)
class Buffer:
    branches: list[Branch]
    bytes: int
    opened: int
    updated: int
    closed: int | None = None
    closed_by: str | None = None


@dataclass(slots=True)
class Run:
    """A frozen batch on its way: preparing, then delivering the wake that was checkpointed."""

    batch: Buffer
    stage: str = "preparing"
    retry_at: int = 0
    lease_until: int | None = None
    failures: int = 0
    wake: dict | None = None
    key: str | None = None


@dataclass
class Mailbox:
    """State of one (cell, rule, correlation) stream; its policy and identity are those of its first append."""

    key: str
    policy: Policy
    policy_hash: str
    identity: tuple
    mode: str = "active"
    recent: int = Limits.recent_events
    last: int | None = None
    ring: dict[str, tuple[str, int]] = field(default_factory=dict)  # in order of acceptance
    ledger: dict[str, str] = field(default_factory=dict)
    open: Buffer | None = None
    sealed: deque[Buffer] = field(default_factory=deque)
    run: Run | None = None
    cooldown_until: int | None = None

    # -- admission

    def append(self, event_key: str, content: str, branches: list[Branch], now: int, policy_hash: str | None = None, identity: tuple | None = None) -> tuple[str, int]:
        """("appended" or "duplicate", when it was accepted). A conflict raises and changes nothing."""
        if event_key in self.ring:
            known, at = self.ring[event_key]
            assert_same_input("recent-event", event_key, known, content)
            return "duplicate", at
        if policy_hash is not None:
            assert_same_input("stream-policy", self.key, self.policy_hash, policy_hash)
        if identity is not None and identity != self.identity:
            raise ValueError(f"the stream {self.key} belongs to {self.identity}, not {identity}")
        fresh: dict[str, Branch] = {}
        for b in branches:
            held = self.ledger.get(b.key) or (fresh[b.key].hash if b.key in fresh else None)
            if held is None:
                fresh[b.key] = b
            else:
                assert_same_input("branch", b.key, held, b.hash)
        at = now if self.last is None else max(now, self.last)
        self.last = at
        for b in fresh.values():
            self.ledger[b.key] = b.hash
            self._hold(b, at)
        self.ring[event_key] = (content, at)
        while len(self.ring) > self.recent:
            del self.ring[next(iter(self.ring))]
        return "appended", at

    def fits(self, branches: list[Branch], limits: Limits) -> bool:
        """Whether an append keeps what is pending within the limits."""
        held = [*self.sealed, *([self.open] if self.open else []), *([self.run.batch] if self.run else [])]
        return len(self.ledger) + len(branches) <= limits.max_pending_branches and sum(b.bytes for b in held) + sum(b.bytes for b in branches) <= limits.max_pending_bytes

    def _hold(self, b: Branch, at: int) -> None:
        p = self.policy
        if p.mode == "immediate":
            if self.cooldown_until is None or self.cooldown_until <= at:
                self.sealed.append(Buffer([b], b.bytes, at, at, at, "immediate"))
                return
        elif self.open is not None:  # what would overflow closes before the branch is added
            why = "max-events" if len(self.open.branches) >= p.max_events else "max-bytes" if self.open.bytes + b.bytes > p.max_bytes else None
            if why:
                self.open.closed, self.open.closed_by = at, why
                self.sealed.append(self.open)
                self.open = None
        if self.open is None:
            self.open = Buffer([], 0, at, at)
        self.open.branches.append(b)
        self.open.bytes += b.bytes
        self.open.updated = at

    # -- time

    def _limits(self) -> tuple[int, int]:
        """When the open batch has been quiet for long enough, and when it has waited for long enough."""
        if self.policy.mode == "immediate":
            return self.open.updated, self.open.updated
        return self.open.updated + self.policy.quiet_ms, self.open.opened + self.policy.max_wait_ms

    def due(self) -> int | None:
        """When something can next happen without a new append."""
        if self.run is not None:
            return max(self.run.retry_at, self.run.lease_until or self.run.retry_at)
        if self.sealed:
            return self.sealed[0].closed if self.cooldown_until is None else self.cooldown_until
        if self.open is not None:
            at = min(self._limits())
            return at if self.cooldown_until is None else max(at, self.cooldown_until)
        return self.cooldown_until

    def claim(self, now: int, lease_ms: int = Limits.lease_ms) -> Run | None:
        """The run to work on at `now`, under a lease; None if nothing is due."""
        if self.run is None:
            batch = self._freeze(now)
            if batch is None:
                return None
            self.run = Run(batch, retry_at=now)
        elif self.run.retry_at > now or (self.run.lease_until or 0) > now:
            return None
        self.run.lease_until = now + lease_ms
        return self.run

    def _freeze(self, now: int) -> Buffer | None:
        if self.cooldown_until is not None and self.cooldown_until > now:
            return None
        if self.sealed:
            batch = self.sealed.popleft()
        elif self.open is not None:
            quiet, longest = self._limits()
            if self.cooldown_until is not None:
                why = "cooldown-expired"
            elif self.policy.mode == "immediate":
                why = "immediate"
            elif min(quiet, longest) > now:
                return None
            else:
                why = "max-wait" if longest <= quiet else "quiet-period"
            batch, self.open, self.cooldown_until = self.open, None, None
            batch.closed, batch.closed_by = now, why
        else:
            self.cooldown_until = None
            return None
        batch.branches.sort(key=Branch.rank)
        return batch

    # -- a run's end

    def finish(self, now: int, woke: bool) -> None:
        for b in self.run.batch.branches:
            self.ledger.pop(b.key, None)
        self.run = None
        if not woke or self.policy.cooldown_ms is None:
            return
        self.cooldown_until = now + self.policy.cooldown_ms
        if self.policy.mode == "immediate":  # what waits becomes one batch for the time after the cooldown
            waiting = [*self.sealed, *([self.open] if self.open else [])]
            if waiting:
                every = [b for w in waiting for b in w.branches]
                self.open = Buffer(every, sum(b.bytes for b in every), min(w.opened for w in waiting), now)
                self.sealed.clear()

    def fail(self, now: int, terminal: bool, limits: Limits) -> str:
        run = self.run
        run.lease_until = None
        run.failures += 1
        if terminal or run.failures >= limits.max_attempts:
            self.finish(now, woke=False)
            return "terminal"
        run.retry_at = now + limits.retry_delay_ms
        return "failed"

    # -- as a value

    def dump(self) -> dict:
        out = asdict(self)
        out["sealed"] = [asdict(b) for b in self.sealed]
        out["ring"] = [[k, *v] for k, v in self.ring.items()]
        return out

    @classmethod
    def load(cls, d: dict) -> Mailbox:
        buffer = lambda x: None if x is None else Buffer(**{**x, "branches": [Branch(**b) for b in x["branches"]]})
        run = d["run"] and Run(**{**d["run"], "batch": buffer(d["run"]["batch"])})
        return cls(**{
            **d, "policy": Policy(**d["policy"]), "identity": tuple(d["identity"]), "ring": {k: (h, t) for k, h, t in d["ring"]},
            "open": buffer(d["open"]), "sealed": deque(map(buffer, d["sealed"])), "run": run,
        })


def settle(box: Mailbox, until: int | None, decide) -> list[tuple[Buffer, dict | None]]:
    """Fire, each at its exact time, what is due before `until` (None: all). decide(batch) gives an outcome (None: undecided).

    An append at exactly a deadline comes before it, so deadlines at `until` itself stay.
    """
    out = []
    while (due := box.due()) is not None and (until is None or due < until):
        run = box.claim(due)
        if run is None:  # a cooldown ran out with nothing waiting
            continue
        outcome = decide(run.batch)
        out.append((run.batch, outcome))
        box.finish(due, woke=outcome is not None and outcome["kind"] == "wake")
    return out
