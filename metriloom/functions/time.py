"""Time columns: buckets and epoch arithmetic that work on TIMESTAMP and TIMESTAMP_NTZ alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch (UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_to(ts: str | Column, seconds: int) -> Column:
    """Start of the ``seconds`` long bucket holding ``ts``."""
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(seconds * MICROS)))


def round_half_even_to(ts: str | Column, seconds: int) -> Column:
    """Nearest bucket start; a time exactly between two goes to the even bucket."""
    size = seconds * MICROS
    us = micros(ts)
    rest = F.pmod(us, F.lit(size))
    lower = us - rest
    lower_is_odd = F.pmod(lower, F.lit(2 * size)) != 0
    up = (rest * 2 > size) | ((rest * 2 == size) & lower_is_odd)
    return from_micros(F.when(up, lower + size).otherwise(lower))


def add_seconds(ts: str | Column, seconds: Column | int) -> Column:
    s = F.lit(seconds) if isinstance(seconds, int) else seconds
    return from_micros(micros(ts) + s.cast("bigint") * F.lit(MICROS))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS))
