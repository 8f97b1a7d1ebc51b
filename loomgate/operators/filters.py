"""Predicates and scores as column expressions; every "now" is a parameter."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import age_days

HALF_LIFE_DAYS, RECENCY_WEIGHT, ABSTAIN_BELOW, STALLED_HOURS = 90.0, 0.8, 1e-6, 24


def board_filter(column: str, board_ids: list[int] | None) -> Column:
    """None passes everything, an empty list nothing."""
    return F.lit(True) if board_ids is None else F.coalesce(F.col(column).isin(list(board_ids)), F.lit(False)) if board_ids else F.lit(False)


def current_filter(only_current: bool, column: str = "is_current") -> Column:
    return F.col(column) if only_current else F.lit(True)


def as_of_posted(column: str, as_of: date | None, inclusive: bool = False) -> Column:
    """Nulls pass; the day counts up to its midnight, or whole if inclusive."""
    if as_of is None:
        return F.lit(True)
    end = F.lit(as_of).cast("timestamp")
    return F.col(column).isNull() | (F.col(column) < end + F.expr("interval 1 day") if inclusive else F.col(column) <= end)


def as_of_effective(column: str, as_of: date | None) -> Column:
    return F.lit(True) if as_of is None else F.col(column).isNull() | (F.col(column) <= F.lit(as_of))


def in_band(value, low: str = "amount_min", high: str = "amount_max") -> Column:
    """Whether a value lies in a closed band; null bounds are open."""
    v = value if isinstance(value, Column) else F.lit(value)
    return (F.col(low).isNull() | (F.col(low) <= v)) & (F.col(high).isNull() | (v <= F.col(high)))


def recency(raw: Column, posted: Column, now: Column, weight: float = RECENCY_WEIGHT, half: float = HALF_LIFE_DAYS, clamp: bool = True) -> Column:
    """raw * (1 + weight / (1 + age / half)); no date adds nothing. clamp counts future dates as today."""
    age = age_days(now, posted)
    age = F.when(age < 0, 0.0).otherwise(age) if clamp else age  # greatest() would take a missing date for today
    return raw * (1.0 + weight * F.coalesce(1.0 / (1.0 + age / half), F.lit(0.0)))


def contains_escaped(column: str, text: str) -> Column:
    """Case-insensitive substring; percent and underscore in the text mean themselves."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def non_blank(column: str) -> Column:
    return F.length(F.trim(F.col(column))) > 0


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def stalled(now: Column, hours: int = STALLED_HOURS) -> Column:
    """Some sign of life exists, and the last is older than so many hours."""
    last = F.greatest("last_success_at", "heartbeat_at")
    return last.isNotNull() & (last < now - F.make_interval(hours=F.lit(hours)))


def is_image(kind: str = "kind", table: str = "is_table") -> Column:
    return (F.col(kind) == "image") | F.col(table)


def is_text(kind: str = "kind", table: str = "is_table") -> Column:
    return F.col(kind).isin("hwp", "pdf", "word", "excel") & ~F.col(table)


def clamp(n: int, low: int = 1, high: int = 30) -> int:
    return max(low, min(n, high))


def watermark(column: str, mark) -> Column:
    """Rows above a mark; without one, all."""
    return F.lit(True) if mark is None else F.col(column) > F.lit(mark)
