"""Confidence ranks and the numeric helpers the policy rules use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftgate.schemas import BLOCKING_CONFIDENCES, CONFIDENCE_ORDER

MS_PER_DAY = 86_400_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def confidence_rank(conf) -> Column:
    """Position in the confidence order, -1 for an unknown class."""
    return F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE_ORDER]), _c(conf)).cast("int") - 1


def can_block(conf, min_conf) -> Column:
    """A finding may block when its confidence is neither conflicting nor unavailable and
    ranks at or above the policy minimum."""
    c = _c(conf)
    return F.coalesce(c.isNotNull() & ~c.isin("conflicting", "unavailable")
                      & (confidence_rank(c) >= confidence_rank(min_conf)), F.lit(False))


def blocking_eligible(conf) -> Column:
    """The confidence is one of the two verified classes."""
    return F.coalesce(_c(conf).isin(BLOCKING_CONFIDENCES), F.lit(False))


def pct_increase(approved, current) -> Column:
    """Percent change; an approved 0 gives +inf for a rise, else 0."""
    a, c = _c(approved), _c(current)
    return (F.when(a == 0, F.when(c > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
             .otherwise((c - a) / a * 100.0))


def parse_instant(s) -> Column:
    """A date or ISO datetime string as a timestamp; unparseable text gives null."""
    return F.try_to_timestamp(_c(s))


def days_until(date_str, now) -> Column:
    """Whole days (rounded up) from ``now`` to the date; null if unparseable."""
    t = parse_instant(date_str)
    return F.ceil((F.unix_millis(t) - F.unix_millis(_c(now))) / F.lit(float(MS_PER_DAY))).cast("long")
