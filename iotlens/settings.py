"""Tunable values with checks at plan-build time."""

from __future__ import annotations

import math
from dataclasses import dataclass

SECOND_US = 1_000_000

# Detection thresholds.
RATE_RULE_LIMIT = 0.95
SIZE_RULE_LIMIT = 0.97
SUSPICIOUS_LIMIT = 0.50
RATE_LIMIT_THRESHOLD = 0.75
DROP_THRESHOLD = 0.90

# Window widths and caps of the behavioral vector.
RATE_WINDOW_US = 1 * SECOND_US
SHORT_WINDOW_US = 10 * SECOND_US
LONG_WINDOW_US = 30 * SECOND_US
GAP_CAP_MS = 1000
SESSION_CAP_S = 300.0
RATE_CAP = 20.0
RESOURCE_CAP = 32.0
BREADTH_CAP = 16.0
RECONNECT_CAP = 30.0
SIZE_CAP = 4096.0
SIZE_STD_CAP = 2048.0
RATIO_CAP = 64.0
DEPTH_CAP = 8.0
ENTROPY_CAP = 4.0
OPTION_CAP = 16.0
KEEPALIVE_CAP = 300.0
KEEPALIVE_DEFAULT = 60.0


def unit_setting(text: str | None, fallback: float) -> float:
    """A setting given as text: finite, fully numeric and inside [0, 1], else the fallback."""
    if text is None or text != text.strip():
        return fallback
    try:
        value = float(text)
    except ValueError:
        return fallback
    return value if math.isfinite(value) and 0.0 <= value <= 1.0 else fallback


@dataclass(frozen=True)
class Detection:
    """Thresholds of rules and decisions; each must lie in [0, 1]."""

    rate_rule: float = RATE_RULE_LIMIT
    size_rule: float = SIZE_RULE_LIMIT
    suspicious: float = SUSPICIOUS_LIMIT
    rate_limit: float = RATE_LIMIT_THRESHOLD
    drop: float = DROP_THRESHOLD

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if not (math.isfinite(value) and 0.0 <= value <= 1.0):
                raise ValueError(f"{name} must be within [0, 1], got {value}")

    @classmethod
    def from_texts(cls, rate_limit: str | None = None, drop: str | None = None) -> "Detection":
        return cls(
            rate_limit=unit_setting(rate_limit, RATE_LIMIT_THRESHOLD),
            drop=unit_setting(drop, DROP_THRESHOLD),
        )


@dataclass(frozen=True)
class Buckets:
    """Width of the time buckets that split the timeline of one source.

    A source that sends a third of all rows is worked on by as many tasks as it has
    buckets.  A bucket must cover the widest window; rows of the last window of a
    bucket are copied into the next one, so the copy share is ``LONG_WINDOW / width``.
    """

    width_us: int = 120 * SECOND_US

    def __post_init__(self) -> None:
        if self.width_us < LONG_WINDOW_US:
            raise ValueError("a bucket must be at least as wide as the longest window")


@dataclass(frozen=True)
class Slots:
    """Fine slots of a source's timeline, for sources that send more than one task should sort in a bucket's width.

    A slot is the unit of work: a source with all rows of a minute is worked on in as many pieces as the minute has
    slots.  Buckets of slots only keep the scan over a long timeline's slot totals in pieces too.
    """

    width_us: int = 120 * SECOND_US
    slot_us: int = SECOND_US // 2

    def __post_init__(self) -> None:
        if not 0 < self.slot_us <= min(SHORT_WINDOW_US, self.width_us):
            raise ValueError("a slot must be positive and no wider than the window of distinct resources or its bucket")
