"""A keyed catalog of sources: loading, grouping, details and faults of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.ordered import one_of_each


def load(records: DataFrame, key: str = "source_key", order: tuple[str, ...] = ("file_ord", "row_ord")) -> DataFrame:
    """The records by key, the later winning; records without a key are left out."""
    return one_of_each(records.where(F.coalesce(key, F.lit("")) != ""), [key], list(order))


def faults(records: DataFrame, key: str = "source_key") -> DataFrame:
    """file_ord, row_ord, key, code and severity of what is wrong with the records: no key, a key
    that a later record takes, nothing that tells where it is, an evidence class that isn't one."""
    repeated = records.groupBy(key).agg(F.max(F.struct("file_ord", "row_ord")).alias("last")).where(f"{key} is not null")
    marked = records.join(repeated, key, "left")
    here = F.struct("file_ord", "row_ord")
    nowhere = F.col("url").isNull() & F.col("parts").isNull() & F.col("held_by").isNull()
    codes = F.array_compact(
        F.array(
            F.when(F.coalesce(key, F.lit("")) == "", F.struct(F.lit("no_key").alias("code"), F.lit("error").alias("severity"))),
            F.when(here < F.col("last"), F.struct(F.lit("key_taken_later").alias("code"), F.lit("warning").alias("severity"))),
            F.when(nowhere, F.struct(F.lit("no_place").alias("code"), F.lit("warning").alias("severity"))),
            F.when(~F.col("evidence").isin("P", "R", "T"), F.struct(F.lit("unknown_evidence").alias("code"), F.lit("error").alias("severity"))),
        )
    )
    return marked.select("file_ord", "row_ord", F.col(key).alias("key"), F.explode(codes).alias("c")).select("file_ord", "row_ord", "key", "c.code", "c.severity")


def grouped(catalog: DataFrame, headings: list[str]) -> DataFrame:
    """entry_type, its place, source_key, place_in_type and size of type: the listed types first,
    then the others by name; inside a type by date as text and key. Entries without a type are of
    the type "other". A type's list is cut by nothing; its order is one sort of the catalog."""
    known = F.array_position(F.array(*map(F.lit, headings)), F.col("entry_type"))
    rank = F.when(known > 0, known).otherwise(len(headings) + 1)
    typed = catalog.withColumn("entry_type", F.coalesce("entry_type", F.lit("other"))).withColumn("type_rank", rank.cast("int"))
    inside = Window.partitionBy("entry_type").orderBy(F.concat(F.coalesce("date_raw", F.lit("")), F.col("source_key")))
    return typed.select(
        "entry_type", "type_rank", "source_key",
        F.row_number().over(inside).alias("place_in_type"), F.count("*").over(Window.partitionBy("entry_type")).alias("n_of_type"),
    )


def details(catalog: DataFrame) -> DataFrame:
    """source_key and the lines of its description: who holds it, pages and gaps on one line,
    then the notes; what is null or empty is skipped."""
    full = {c: F.nullif(F.col(c), F.lit("")) for c in ("held_by", "pages", "gaps", "notes")}
    holdings = F.nullif(F.concat_ws(" · ", full["held_by"], full["pages"], full["gaps"]), F.lit(""))
    return catalog.select("source_key", F.concat_ws("<br>", holdings, full["notes"]).alias("detail"))


def date_precision(raw: Column) -> Column:
    """day, month, year or text: what a date as written tells; null for null."""
    return (
        F.when(raw.isNull(), None)
        .when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(raw).isNotNull(), "day")
        .when(raw.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), "month")
        .when(raw.rlike(r"^\d{4}$"), "year")
        .otherwise("text")
    )


def unknown_keys(used: DataFrame, key: str, catalog: DataFrame, catalog_key: str = "source_key") -> DataFrame:
    """key and n_uses of the keys that the catalog doesn't have. Uses are counted first, so each
    key is joined once."""
    counts = used.where(F.coalesce(key, F.lit("")) != "").groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_uses"))
    return counts.join(catalog.select(F.col(catalog_key).alias("key")).distinct(), "key", "left_anti")


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; a column that is missing raises, with the names of all that are."""
    if gone := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"columns {gone} are missing; there are {rows.columns}")
    return rows


def kept_rows(rows: DataFrame, keep: str, title: str) -> DataFrame:
    """The rows that are marked to be kept (y or yes, whatever the case and the space around), with
    is_reported: those without a title are reported instead of used. Null marks keep nothing."""
    required(rows, [keep, title])
    marked = F.lower(F.trim(F.coalesce(keep, F.lit("")))).isin("y", "yes")
    return rows.where(marked).withColumn("is_reported", F.trim(F.coalesce(title, F.lit(""))) == "")


def issue_dates(lines: DataFrame, line: str, order: list[str], prefix: str) -> DataFrame:
    """paper and issued from tab-separated lines among others: two fields or more, an id that starts
    with the prefix, a date as yyyy-mm-dd. Of lines with one id the last by order wins."""
    parts = F.split(line, "\t", -1)
    dated = (F.size(parts) >= 2) & F.get(parts, F.lit(0)).startswith(prefix) & F.get(parts, F.lit(1)).rlike(r"^\d{4}-\d{2}-\d{2}$")
    valid = lines.where(dated).select(F.get(parts, F.lit(0)).alias("paper"), F.get(parts, F.lit(1)).alias("issued"), *order)
    return one_of_each(valid, ["paper"], order).select("paper", "issued")
