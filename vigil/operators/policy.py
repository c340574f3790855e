"""Mailbox policies and limits."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.scalars import duration_ms, positive


@dataclass(frozen=True)
class Policy:
    """mode immediate, or debounce with its four limits; cooldown after a wake if given. All times in milliseconds."""

    mode: str
    quiet_ms: int | None = None
    max_wait_ms: int | None = None
    max_events: int | None = None
    max_bytes: int | None = None
    cooldown_ms: int | None = None

    def value(self) -> dict:
        """The policy as a JSON value without absent fields."""
        names = {"mode": "mode", "quiet_ms": "quietPeriodMs", "max_wait_ms": "maxWaitMs", "max_events": "maxEvents", "max_bytes": "maxBytes"}
        out: dict = {"buffer": {v: getattr(self, k) for k, v in names.items() if getattr(self, k) is not None}}
        return out | ({} if self.cooldown_ms is None else {"cooldownAfterWakeMs": self.cooldown_ms})


def immediate(cooldown: int | str | None = None) -> Policy:
    """Every branch is a batch of its own, but for those that wait for a cooldown's end."""
    return Policy("immediate", cooldown_ms=None if cooldown is None else duration_ms(cooldown))


def debounce(quiet: int | str, max_wait: int | str, cooldown: int | str | None = None, max_events: int = 100, max_bytes: int = 1_000_000) -> Policy:
    """A batch closes after a quiet period, a longest wait, or before it would hold too many events or bytes."""
    return Policy("debounce", duration_ms(quiet), duration_ms(max_wait), positive(max_events, "max_events"), positive(max_bytes, "max_bytes"), None if cooldown is None else duration_ms(cooldown))


@dataclass(frozen=True)
class Limits:
    """Capacities; each is checked where it applies."""

    recent_events: int = 48
    retry_delay_ms: int = 1_000
    lease_ms: int = 30_000
    max_attempts: int = 10
    max_branches: int = 1_000
    max_fanout_bytes: int = 16 << 20
    max_wake_bytes: int = 1 << 20
    max_pending_branches: int = 1_000
    max_pending_bytes: int = 16 << 20

    def __post_init__(self):
        for k, v in vars(self).items():
            positive(v, k)
