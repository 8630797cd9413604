"""What changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import written


def latest_rows(
    snapshots: DataFrame, snapshot: str, key: str, order: str, values: list[str]
) -> DataFrame:
    """One row for each snapshot and key: the one with the largest order (ties: the largest
    values, so the result is stable; a null order is the smallest). Keys compare as stored; rows
    with a null key have none and are left out. Only the named columns are read. The maximum is
    taken before the shuffle, so a key with many rows costs no more than one with few."""
    best = F.max(F.struct(order, *values)).alias("best")
    known = snapshots.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
    return known.groupBy(F.col(snapshot).alias("snapshot_no"), F.col(key).alias("key")).agg(best).select(
        "snapshot_no", "key", *(F.col("best")[v].alias(v) for v in values)
    )


def except_all_both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """left EXCEPT ALL right and right EXCEPT ALL left in one pass: the rows of either with the
    column net, how many more of it left has (below 0: right). Rows in both alike are gone. Nulls
    equal nulls. Both sides are counted before the one shuffle."""
    columns = left.columns
    tagged = left.withColumn("net", F.lit(1)).unionByName(right.withColumn("net", F.lit(-1)))
    return tagged.groupBy(*columns).agg(F.sum("net").alias("net")).where("net != 0")


def changes(snapshots: DataFrame, snapshot: str, key: str, order: str, values: list[str]) -> DataFrame:
    """The keys added, removed or changed in each snapshot against the one before: snapshot_no,
    key, change_kind, and old_ and new_ of each value.

    The first snapshot has no changes; after a gap in the numbers a snapshot is held against the
    last one there is. An empty table or a single snapshot gives no rows. Values compare as
    stored, null only equal to null.
    """
    latest = written(latest_rows(snapshots, snapshot, key, order, values), "latest-rows")
    # one row for each delivery: as few as there are periods, so it is broadcast
    numbers = latest.select("snapshot_no").distinct()
    pairs = numbers.select(
        F.col("snapshot_no").alias("before"), F.lead("snapshot_no").over(Window.orderBy("snapshot_no")).alias("after")
    ).where("after is not null")
    earlier = latest.join(F.broadcast(pairs), latest.snapshot_no == pairs.before).select(
        F.col("after").alias("snapshot_no"), "key", *values
    )
    later = latest.join(F.broadcast(pairs), latest.snapshot_no == pairs.after, "left_semi")
    residue = except_all_both_ways(later, earlier)
    new = residue.where("net > 0").select("snapshot_no", "key", F.lit(True).alias("is_new"), *(F.col(v).alias(f"new_{v}") for v in values))
    old = residue.where("net < 0").select("snapshot_no", "key", F.lit(True).alias("is_old"), *(F.col(v).alias(f"old_{v}") for v in values))
    kind = F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "removed").otherwise("changed")
    return new.join(old, ["snapshot_no", "key"], "full_outer").select(
        "snapshot_no", "key", kind.alias("change_kind"), *(f"{side}_{v}" for v in values for side in ("old", "new"))
    )
