"""References to records that do not exist at the time they are made.

Parents and children come together in one long form (parent table, key, time, tag) and are grouped
by parent table and key. The references of a group that lacks the parent flag are orphans, all of
them. In the other groups it depends on the time: a reference holds if the latest end among the
parents that began before it is still ahead. In order of time that is one running maximum, no join
and no interval list.

A key that holds many rows has few parents as a rule: its running maximum is a short list of steps,
which its references are held against where they lie, also if all are made at one time. A key with
many rows of both is cut into spans of time of about as many rows, each its own group. What the
earlier spans hand on (the latest end so far) is one number, found from one pre-aggregated row a
span and given to the next as one more parent row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.skew import small
from quirework.session import written

#: The end of a record that is still there.
OPEN_END = "9999-12-31 00:00:00"
#: Rows of one key in one group; a key with more is a hot one.
GROUP_ROWS = 100_000
#: Parents of a hot key that are held as a list of steps.
STEPS = 200


@dataclass(frozen=True)
class Reference:
    """One reference: a column of a child table and the parent table's key and life span."""

    child: DataFrame
    table_name: str
    field_name: str
    row_id: str
    made_at: str
    key: Column
    parent: DataFrame
    parent_name: str
    parent_key: str
    begins: str
    ends: str


def long_form(references: list[Reference]) -> DataFrame:
    """Tagged parents (at = begin) and children (at = time of the reference) under one key.

    Null and empty keys are no references and no targets; a child without a time is judged as
    if made before every record, so it is an orphan; a parent without a begin never began.
    A parent table that several references name comes in once.
    """
    parts = []
    parents = {}
    for r in references:
        children = r.child.where(r.key.isNotNull() & (r.key != ""))
        parts.append(children.select(
            F.lit(r.parent_name).alias("parent"),
            r.key.alias("key"),
            F.lit(False).alias("is_parent"),
            F.coalesce(F.col(r.made_at), F.lit("0001-01-01").cast("timestamp")).alias("at"),
            F.lit(None).cast("timestamp").alias("until"),
            F.lit(r.table_name).alias("table_name"),
            F.lit(r.field_name).alias("field_name"),
            F.col(r.row_id).cast("bigint").alias("row_id"),
        ))
        parents[r.parent_name, r.parent_key] = r
    for r in parents.values():
        known = r.parent.where((F.col(r.parent_key) != "") & F.col(r.begins).isNotNull())
        # rows of one key and begin are one: the longest life counts
        parts.append(
            known.groupBy(F.col(r.parent_key).alias("key"), F.col(r.begins).alias("at"))
            .agg(F.max(F.coalesce(F.col(r.ends), F.lit(OPEN_END).cast("timestamp"))).alias("until"))
            .select(
                F.lit(r.parent_name).alias("parent"),
                "key",
                F.lit(True).alias("is_parent"),
                "at",
                "until",
                F.lit(None).cast("string").alias("table_name"),
                F.lit(None).cast("string").alias("field_name"),
                F.lit(None).cast("bigint").alias("row_id"),
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


GROUP = ["parent", "key"]


def grouped(events: DataFrame) -> DataFrame:
    """parent, key, has_parent (the flag), n and n_parents of each group. Counted before the
    shuffle, so a key costs the same however many rows it has."""
    flag = F.bool_or("is_parent").alias("has_parent")
    return events.groupBy(*GROUP).agg(flag, F.count("*").alias("n"), F.count_if("is_parent").alias("n_parents"))


def with_spans(events: DataFrame, hot: DataFrame, group_rows: int) -> DataFrame:
    """Adds bounds and span: null and 0 for a key that isn't hot, else the times that cut the key's
    rows evenly, and the number of them that a row's time has reached."""
    most = hot.agg(F.max("n")).collect()[0][0]
    if most is None:
        return events.withColumns({"bounds": F.lit(None).cast("array<timestamp>"), "span": F.lit(0)})
    pieces = math.ceil(most / group_rows)
    cuts = F.array_distinct(F.percentile_approx("at", [k / pieces for k in range(1, pieces)] or [0.5], 10_000))
    bounds = events.join(small(hot.select(*GROUP)), GROUP, "left_semi").groupBy(*GROUP).agg(F.array_sort(cuts).alias("bounds"))
    reached = F.size(F.filter("bounds", lambda b: b <= F.col("at")))
    return events.join(small(written(bounds, "orphan-bounds")), GROUP, "left").withColumn("span", F.when(F.col("bounds").isNull(), 0).otherwise(reached))


def swept(events: DataFrame) -> DataFrame:
    """The children with latest, the running maximum of the parents' ends up to their time."""
    before = Window.partitionBy(*GROUP).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each span of a hot key
    handed = (
        events.where(F.col("bounds").isNotNull())
        .groupBy(*GROUP, "span")
        .agg(F.max("until").alias("span_until"), F.first("bounds").alias("bounds"))
        .withColumn("until", F.max("span_until").over(before))
        .where(F.col("until").isNotNull())
        .select(
            *GROUP, F.lit(True).alias("is_parent"), F.element_at("bounds", F.col("span")).alias("at"), "until",
            F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("bigint").alias("row_id"), "span",
        )
    )
    order = Window.partitionBy(*GROUP, "span").orderBy("at", F.col("is_parent").desc())
    sweep = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.drop("bounds").unionByName(handed).withColumn("latest", F.max("until").over(sweep)).where("not is_parent")


def orphan_references(references: list[Reference], group_rows: int = GROUP_ROWS, most_steps: int = STEPS) -> DataFrame:
    """The references without a target at their time: table_name, field_name, row_id, key, at,
    and state, which is `removed` if the key's records ended before, else `absent` (no record of
    the key had begun by then).

    Repeated children each count; repeated parents change nothing; empty tables are allowed on
    either side. Only the named columns are read, so others may clash.
    """
    events = written(long_form(references), "orphan-events")
    groups = written(grouped(events), "orphan-groups")
    lacking = small(groups.where("not has_parent").select(*GROUP))
    hot = groups.where((F.col("n") > group_rows) & F.col("has_parent"))
    stepped = small(hot.where(F.col("n_parents") <= most_steps).select(*GROUP))
    children = events.where("not is_parent")
    never = children.join(lacking, GROUP, "left_semi").withColumn("latest", F.lit(None).cast("timestamp"))
    # a group has at most most_steps of these
    steps = events.where("is_parent").join(stepped, GROUP, "left_semi").groupBy(*GROUP).agg(F.collect_list(F.struct("at", "until")).alias("steps"))
    begun = F.filter("steps", lambda s: s["at"] <= F.col("at"))
    held = children.join(small(written(steps, "orphan-steps")), GROUP).withColumn("latest", F.array_max(F.transform(begun, lambda s: s["until"]))).drop("steps")
    rest = events.join(lacking, GROUP, "left_anti").join(stepped, GROUP, "left_anti")
    timed = swept(with_spans(rest, hot.where(F.col("n_parents") > most_steps), group_rows))
    every = [x.select(*GROUP, "at", "table_name", "field_name", "row_id", "latest") for x in (never, held, timed)]
    judged = every[0].unionByName(every[1]).unionByName(every[2])
    return judged.where(F.col("latest").isNull() | (F.col("latest") <= F.col("at"))).select(
        "table_name", "field_name", "row_id", "key",
        F.nullif("at", F.lit("0001-01-01").cast("timestamp")).alias("at"),
        F.when(F.col("latest").isNull(), "absent").otherwise("removed").alias("state"),
    )


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """Orphan references counted per table, field, month (yyyy-MM) and state."""
    return orphans.groupBy(
        "table_name", "field_name", F.date_format("at", "yyyy-MM").alias("month"), "state"
    ).agg(F.count("*").alias("n_orphans"), F.count_distinct("key").alias("n_keys"))
