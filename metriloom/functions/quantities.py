"""Kubernetes resource quantities as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from metriloom.functions.time import col

# fixed values: factor of each suffix
GIGABYTES = {"Ki": 1 / (1024.0 * 1024.0), "Mi": 1 / 1024.0, "Gi": 1.0, "Ti": 1024.0}
BYTES = {"Ki": 1024.0, "Mi": 1024.0**2, "Gi": 1024.0**3, "K": 1000.0, "M": 1000.0**2, "G": 1000.0**3}


def finite(number: str | Column) -> Column:
    """The number as double; NaN, infinite and unreadable values are NULL."""
    n = col(number).try_cast("double")
    return F.when(F.abs(n) < F.lit(float("inf")), n)  # NaN is above every number


def _scaled(text: Column, factors: Mapping[str, float]) -> Column:
    """Number before a known suffix times its factor, or the plain number; NULL for anything else."""
    t = F.trim(text)
    out = t.try_cast("double")
    for suffix, factor in factors.items():
        head = F.substring(t, F.lit(1), F.length(t) - len(suffix))
        out = F.when(F.endswith(t, F.lit(suffix)), head.try_cast("double") * factor).otherwise(out)
    return out


def cost_quantity(text: str | Column) -> Column:
    """Cores or gigabytes; empty or bad text is 0."""
    return F.coalesce(_scaled(col(text), {"m": 0.001, **GIGABYTES}), F.lit(0.0))


def millicores(text: str | Column) -> Column:
    """Millicores; bad text is NULL."""
    t = col(text)
    return F.when(F.endswith(t, F.lit("m")), _scaled(t, {"m": 1.0})).otherwise(t.try_cast("double") * 1000)


def memory_bytes(text: str | Column) -> Column:
    """Bytes; bad text is NULL."""
    return _scaled(col(text), BYTES)
