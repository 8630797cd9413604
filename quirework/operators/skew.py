"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many rows, so there are fewer hot keys than that.
HOT_SHARE = 1000


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with keyed, which has one row for each key and in `count` how many rows the
    key has; total is the sum of those counts.

    The rows of hot keys (more than total / HOT_SHARE rows) meet their side by broadcast and are
    not moved: fewer than HOT_SHARE rows are broadcast, whatever the data. All other rows are
    joined by a shuffle, in which no key has more than total / HOT_SHARE rows.
    Null keys match nothing.
    """
    limit = max(total // HOT_SHARE, 1)
    hot = keyed.where(F.col(count) > limit)
    cold = keyed.where(F.col(count) <= limit)
    marked = F.broadcast(hot.select(key))
    with_hot = rows.join(F.broadcast(hot), key)
    with_cold = rows.join(marked, key, "left_anti").join(cold, key)
    return with_hot.unionByName(with_cold)


#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """A table for the other side of a join, broadcast only where it was counted to be small. Count
    a written table: any other is computed for the count as well."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
