"""Helpers for conversation tables, shared by the operators on turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metriloom.session import written

#: a word is a run of characters that are not ASCII blanks
WORD = r"[^\x20\x09-\x0D]+"


def numbered(df: DataFrame, group: str, order: list[str], out: str = "pos") -> DataFrame:
    """0-based position ``out`` of each row in its group by ``order`` (nulls first); a null group is a group.

    Rows are dealt by range of (group, order), so a group that holds a third of the table is sorted by many
    tasks. What a task needs of the others is one row per (group, task): the count of its earlier rows.
    """
    ordered = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = written(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)), "ordered")
    heads = placed.groupBy(F.col(group).alias("_group"), F.col("_task").alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.select("_group", "_of", (F.col("_first") - F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_start"))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_task") == F.col("_of"))
    return placed.join(starts, same).withColumn(out, F.col("_at") - F.col("_start")).select(*df.columns, out)
