"""Sinks: tables and reports as text. Spark's commit protocol makes each write whole or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("term", "definition", "source_key", "locator")


def tsv_lines(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One value a row: the fields, tabs and line ends as spaces, trimmed, null as empty."""
    plain = [F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ")) for c in fields]
    return rows.select(F.concat_ws("\t", *plain).alias("value"))


def write_tsv(rows: DataFrame, path: str, fields: tuple[str, ...] = FIELDS) -> None:
    rows.select(*(F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ")).alias(c) for c in fields)).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def markdown_rows(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of a Markdown table, with the bar of a value made a dot."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("·")) for c in fields]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def spliced(page: Column, begin: str, end: str, new: Column) -> Column:
    """The page with what stands between the first begin mark and the next end mark replaced; null
    if the marks aren't there. Splicing again changes nothing."""
    start = F.instr(page, begin)
    tail = F.substr(page, start + len(begin))
    stop = F.instr(tail, end)
    made = F.concat(F.substr(page, F.lit(1), start + len(begin) - 1), F.lit("\n"), new, F.lit("\n"), F.substr(tail, stop))
    return F.when((start > 0) & (stop > 0), made)


def replaced_marker(page: Column, marker: str, new: Column) -> Column:
    """The page with every such marker replaced; a page without it stays as it is."""
    return F.replace(page, F.lit(marker), new)


def photo_grid(items: DataFrame, page: str, key: str, place: str, photo: str, thumb: str, caption: str) -> DataFrame:
    """key, place and value: the Markdown line of each photo, its small copy linking to the large one,
    both relative to the page that the column `page` names. Rows without a photo give no line."""
    words = F.replace(F.coalesce(caption, F.lit("")), F.lit("]"), F.lit("\\]"))
    link = lambda c: relative_link(F.col(c), F.col(page))
    value = F.concat(F.lit("[!["), words, F.lit("]("), link(thumb), F.lit(")]("), link(photo), F.lit(")"))
    return items.where(F.col(photo).isNotNull() & F.col(thumb).isNotNull()).select(key, place, value.alias("value"))


def relative_link(target: Column, page: Column) -> Column:
    """The way from a page to a target, both as paths from one root."""
    here, there = F.split(page, "/"), F.split(target, "/")
    folders = F.size(here) - 1
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(folders, F.size(there) - 1), F.lit(1))), F.lit(0),
        lambda n, i: F.when((n == i - 1) & (i <= folders) & (i <= F.size(there) - 1) & (F.get(here, i - 1) == F.get(there, i - 1)), i).otherwise(n),
    )
    up = F.array_repeat(F.lit(".."), folders - same)
    return F.array_join(F.concat(up, F.slice(there, same + 1, F.size(there))), "/")
