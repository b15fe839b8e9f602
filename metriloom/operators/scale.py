"""Building blocks that keep one hot series from landing in one task.

A window over ``partitionBy(series)`` sends a series to a single task. Where the rows of a series
are bounded by a time grid (aligned frames) that is fine. Raw samples are not bounded, so the
helpers here cut a series into time chunks, work per chunk, and move only one small row per chunk
between chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriloom.functions.time import MICROS, col, from_micros, micros

DAY = 86_400
#: length of a time chunk. One small row per (series, chunk) moves between chunks, so a short chunk is
#: cheap; with 15 minutes a series holding a third of a 30-day table is spread over 2880 groups.
CHUNK = 900


def chunk_number(ts: str | Column, seconds: int) -> Column:
    us = micros(ts)
    return ((us - F.pmod(us, F.lit(seconds * MICROS))) / F.lit(seconds * MICROS)).cast("bigint")


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join an aggregate back to its rows.

    Neither side is hinted: Spark broadcasts the aggregate if its bytes are below the session's
    threshold, at run time too, and otherwise shuffles both sides and splits skewed partitions.
    """
    return big.join(small, list(on), how)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate (always exactly one row) to every row.

    The row is one scalar subquery, so there is no join and ``df`` is not moved.
    """
    row = one_row.select(F.struct(*one_row.columns).alias("row")).scalar()
    return df.withColumns({c: row[c] for c in one_row.columns})


def _opened(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows plus one head row per chunk, which holds what the earlier chunks hand over.

    Heads sort first in their chunk (``_row`` 0), so one shuffle and one sort serve both; no join.
    """
    return rows.withColumn("_row", F.lit(1)).unionByName(heads.withColumn("_row", F.lit(0)), allowMissingColumns=True)


def _inside(keys: Sequence[str], ts: str, tie: str):
    return Window.partitionBy(*keys, "_chunk").orderBy("_row", ts, tie)


def numbered(df: DataFrame, keys: Sequence[str], ts: str, tie: str, out: str = "row_index", chunk_seconds: int = CHUNK) -> DataFrame:
    """1-based position of each row in its series by (ts, tie), plus ``series_rows``.

    Counts per (series, chunk) give the offset of each chunk; only inside a chunk are rows sorted.
    """
    tagged = df.withColumn("_chunk", chunk_number(ts, chunk_seconds))
    w = Window.partitionBy(*keys)
    heads = (
        tagged.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_n"))
        .select(
            *keys,
            "_chunk",
            (F.sum("_n").over(w.orderBy("_chunk")) - F.col("_n")).alias("_step"),
            F.sum("_n").over(w).alias("_all"),
        )
    )
    upto = _inside(keys, ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce("_step", F.lit(1).cast("bigint"))
    placed = _opened(tagged, heads).withColumn(out, F.sum(step).over(upto)).withColumn("series_rows", F.max("_all").over(upto))
    return placed.where("_row = 1").select(*df.columns, out, "series_rows")


def running_sum(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, out: str, chunk_seconds: int = CHUNK) -> DataFrame:
    """Sum of ``value`` over the series up to and with each row, by (ts, tie).

    The total of the earlier chunks comes from one row per chunk; rows are sorted inside a chunk only.
    """
    tagged = df.withColumn("_chunk", chunk_number(ts, chunk_seconds))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        tagged.groupBy(*keys, "_chunk")
        .agg(F.sum(value).alias("_total"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias(value))
    )
    upto = _inside(keys, ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return _opened(tagged, heads).withColumn(out, F.sum(value).over(upto)).where("_row = 1").select(*df.columns, out)


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, tie: str, columns: dict[str, str], chunk_seconds: int = CHUNK) -> DataFrame:
    """Add the previous row's value of each column (``columns``: source -> new name).

    Inside a chunk this is ``lag``; the first row of a chunk takes the last row of the newest
    earlier chunk, found from one row per chunk.
    """
    tagged = df.withColumn("_chunk", chunk_number(ts, chunk_seconds))
    tail = F.max_by(F.struct(*columns), F.struct(F.col(ts), F.col(tie)))
    heads = (
        tagged.groupBy(*keys, "_chunk")
        .agg(tail.alias("_tail"))
        .select(*keys, "_chunk", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"))
        .select(*keys, "_chunk", "_carry.*")
    )
    w = _inside(keys, ts, tie)
    new = {name: F.lag(src).over(w) for src, name in columns.items()}
    return _opened(tagged, heads).withColumns(new).where("_row = 1").select(*df.columns, *new)


def nth_largest(df: DataFrame, value: Column, n: int, bins: int = 2_000) -> tuple[int, int] | None:
    """The ``n``-th largest of integers and how many are larger; None if there are fewer than ``n``.

    Counting passes over ever finer bins narrow the range around the wanted rank until it is one number, so no
    rows are sorted or ranked, whatever number of them is equal. A pass brings at most ``bins`` counts to the driver.
    """
    base = df.select(value.cast("bigint").alias("v")).where("v IS NOT NULL")
    stats = base.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if stats["n"] < n:
        return None
    lo, hi, above = stats["lo"], stats["hi"], 0
    while lo < hi:
        width = (hi - lo) // bins + 1
        # the distance is taken as a decimal: the ends of the type are further apart than it reaches
        place = F.floor((F.col("v").cast("decimal(20,0)") - F.lit(lo)) / F.lit(width)).cast("bigint")
        counts = base.where(F.col("v").between(lo, hi)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in counts.orderBy(F.desc("b")).collect():
            if above + r["n"] >= n:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo, above


def newest_rows(df: DataFrame, ts: str, tie: str, n: int, bins: int = 2_000) -> DataFrame:
    """The newest ``n`` rows overall by (time, tie), whole and exact.

    The boundary is found by counting: first the time of the n-th newest row, and if rows of that one time are
    more than are wanted, the tie that cuts them. The rows are then taken by comparisons with literals, so no task
    ranks anything, even if all rows have one time. Rows equal in both are alike for this order; as many as
    are wanted are taken. A table of fewer rows is returned as it is, rows without a time or tie included.
    """
    if n <= 0:
        return df.limit(0)
    found = nth_largest(df, micros(ts), n, bins)
    if found is None:
        return df
    moment, above = found
    at = from_micros(F.lit(moment)).cast(df.schema[ts].dataType)
    newer, same = df.where(F.col(ts) > at), df.where(F.col(ts) == at)
    wanted = n - above
    if same.count() == wanted:
        return df.where(F.col(ts) >= at)
    cut = nth_largest(same, F.col(tie), wanted, bins)
    if cut is None:  # some ties are null; they come last
        untied = wanted - same.where(F.col(tie).isNotNull()).count()
        return newer.unionByName(same.where(F.col(tie).isNotNull())).unionByName(same.where(F.col(tie).isNull()).limit(untied))
    last, before = cut
    edge = same.where(F.col(tie) == last)
    inside = df.where((F.col(ts) > at) | ((F.col(ts) == at) & (F.col(tie) > last)))
    return inside.unionByName(edge.limit(wanted - before))


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank", spread: int = 256) -> DataFrame:
    """Top ``n`` rows per key, in two steps whatever ``n`` is.

    Rows are first ranked per (key, input partition modulo ``spread``): each task keeps ``n`` rows of a key
    before the shuffle, and those of a key present in every task go to ``spread`` groups. The second step
    ranks at most ``spread * n`` rows of a key. The salt changes where rows are ranked, not the result.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(spread)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    few = salted.withColumn("_rk", F.row_number().over(first)).where(F.col("_rk") <= n).drop("_rk", "_salt")
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def exact_percentile(df: DataFrame, column: str, q: float, bins: int = 2_000) -> float | None:
    """Linear-interpolated percentile of a column of any size.

    Counting passes over equal-width bins narrow the range around the wanted ranks. As soon as these lie
    in two bins they are the highest value of the one and the lowest of the other. A pass brings at most
    ``bins`` counted rows to the driver, and no values. NULL and NaN are left out.
    """
    value = col(column)
    base = df.where(value.isNotNull() & ~F.isnan(value)).select(value.cast("double").alias("v"))
    stats = base.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n, lo, hi = stats["n"], stats["lo"], stats["hi"]
    if not n:
        return None
    position = q * (n - 1)
    rank, fraction = int(position), position - int(position)
    want, below = rank + (1 if fraction > 0 else 0), 0
    while lo < hi:
        width = hi / bins - lo / bins
        if lo + width > lo:
            place = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.lit(lo)) / F.lit(width)))
        else:
            place = F.col("v")  # fewer different numbers than bins lie between
        rows = (
            base.where((F.col("v") >= lo) & (F.col("v") <= hi))
            .groupBy(place.alias("b"))
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("lo")
            .collect()
        )
        first = last = None
        seen = below
        for r in rows:
            if first is None and seen + r["n"] > rank:
                first, below = r, seen
            if seen + r["n"] > want:
                last = r
                break
            seen += r["n"]
        if first is not last:
            return first["hi"] + (last["lo"] - first["hi"]) * fraction
        lo, hi = first["lo"], first["hi"]
    return lo
