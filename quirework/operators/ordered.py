"""Ordered operators: last and first wins, running numbers without one task for a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_of_each(rows: DataFrame, keys: list[str], order: list[str], last: bool = True) -> DataFrame:
    """The row of each key with the largest (last wins) or smallest (first wins) order. Ties go by
    the other columns, so the result is stable; null orders are the smallest. Keys may be null and
    then are one key. The choice is a maximum taken before the shuffle, so a key with many rows
    costs no more than one with few. Columns of map type are carried, not compared."""
    others = [c for c in rows.columns if c not in keys and c not in order]
    maps = [c for c, kind in rows.dtypes if kind.startswith("map")]
    compared = [*order, *(c for c in others if c not in maps)]
    whole = F.struct(*compared, *(F.map_entries(m).alias(m) for m in others if m in maps))
    best = (F.max if last else F.min)(whole).alias("_best")
    chosen = rows.groupBy(*keys).agg(best)
    back = {c: F.map_from_entries(F.col("_best")[c]) if c in maps else F.col("_best")[c] for c in rows.columns if c not in keys}
    return chosen.withColumns(back).select(*rows.columns)


def running_number(rows: DataFrame, keys: list[str], position: str, name: str, width: int = 4096) -> DataFrame:
    """Adds name: the row's number in its group, by position (an integer), from 1.

    Each group is cut into spans of `width` positions; rows are numbered within a span, and the
    counts of the earlier spans, one row a span, are added. So no task holds more than a span of
    a hot group. Ties in position go by the other columns; null positions come first.
    """
    cut = rows.withColumn("_span", F.coalesce(F.floor(F.col(position) / width), F.lit(-1)).cast("bigint"))
    counts = cut.groupBy(*keys, "_span").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_span").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ties = [c for c, kind in rows.dtypes if c not in keys and c != position and not kind.startswith("map")]
    own = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(position, *ties))
    same = F.col("_span") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    numbered = cut.withColumn("_own", own).join(offsets, same)
    return numbered.withColumn(name, F.col("_own") + F.col("_offset")).select(*rows.columns, name)


def running_sum(rows: DataFrame, keys: list[str], position: str, value: str, name: str, width: int) -> DataFrame:
    """Adds name: the sum of value from the group's first row to this one, by position. Summed by
    spans of positions as in running_number, so a hot group isn't one task. Null values count 0."""
    cut = rows.withColumn("_span", F.coalesce(F.floor(F.col(position) / width), F.lit(-1)).cast("bigint"))
    sums = cut.groupBy(*keys, "_span").agg(F.sum(F.coalesce(value, F.lit(0))).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_span").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ties = [c for c, kind in rows.dtypes if c not in keys and c != position and not kind.startswith("map")]
    inside = Window.partitionBy(*keys, "_span").orderBy(position, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("_span") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    summed = cut.withColumn("_own", F.sum(F.coalesce(value, F.lit(0))).over(inside)).join(offsets, same)
    return summed.withColumn(name, F.col("_own") + F.col("_offset")).select(*rows.columns, name)


def next_text(rows: DataFrame, keys: list[str], position: str, text: str, name: str, width: int) -> DataFrame:
    """Adds name: the next line of the group that isn't blank, empty if there is none. What follows
    a span is its first such line, one row a span."""
    full = F.when(F.trim(text) != "", F.col(text))
    cut = rows.withColumn("_span", F.coalesce(F.floor(F.col(position) / width), F.lit(-1)).cast("bigint"))
    firsts = cut.groupBy(*keys, "_span").agg(F.min_by(full, F.when(full.isNotNull(), F.col(position))).alias("_first"))
    after = Window.partitionBy(*keys).orderBy("_span").rowsBetween(1, Window.unboundedFollowing)
    following = firsts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_span").alias("_at"), F.first("_first", ignorenulls=True).over(after).alias("_later"))
    ties = [c for c, kind in rows.dtypes if c not in keys and c != position and not kind.startswith("map")]
    inside = Window.partitionBy(*keys, "_span").orderBy(position, *ties).rowsBetween(1, Window.unboundedFollowing)
    same = F.col("_span") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    led = cut.withColumn("_own", F.first(full, ignorenulls=True).over(inside)).join(following, same)
    return led.withColumn(name, F.coalesce("_own", "_later", F.lit(""))).select(*rows.columns, name)
