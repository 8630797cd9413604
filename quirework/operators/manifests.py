"""Manifests: what is listed, missing, new, repeated; keyed updates; names without collisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quirework.functions.text import slugify
from quirework.operators.ordered import one_of_each, running_number, running_sum


def sniff(lines: DataFrame, file: str, row_ord: str, line: str, header: list[str], prefix: str = "") -> DataFrame:
    """file, n_lines and layout of each file of tab-separated lines: `records` if its first line
    has the header's names first, `pairs` if every line has two fields, the second an address that
    starts with the prefix, else `skipped`. Null lines count as empty. One aggregation; no file is
    gathered."""
    fields = F.split(F.coalesce(line, F.lit("")), "\t", -1)
    first = F.min_by(F.slice(fields, 1, len(header)), F.col(row_ord))
    pairs = F.bool_and((F.size(fields) == 2) & F.coalesce(F.get(fields, F.lit(1)), F.lit("")).startswith(prefix))
    grouped = lines.groupBy(file).agg(F.count("*").alias("n_lines"), first.alias("_first"), pairs.alias("_pairs"))
    layout = F.when(F.col("_first") == F.array(*map(F.lit, header)), "records").when(F.col("_pairs"), "pairs").otherwise("skipped")
    return grouped.select(file, "n_lines", layout.alias("layout"))


def sniffed_union(lines: DataFrame, file: str, row_ord: str, line: str, header: list[str], prefix: str = "", only: str | None = None) -> DataFrame:
    """file, layout and the header's fields of the lines of all files that sniff() can read: of
    records the lines after the first, of pairs their two fields (the others null). only keeps a
    folder: files of that name or below it."""
    kept = lines if only is None else lines.where((F.col(file) == only) | F.col(file).startswith(only.rstrip("/") + "/"))
    told = sniff(kept, file, row_ord, line, header, prefix).where("layout <> 'skipped'")
    first = kept.groupBy(F.col(file).alias("_file")).agg(F.min(row_ord).alias("_first"))
    # one row a file on the right
    both = kept.join(told.join(first, F.col(file) == F.col("_file")).select(file, "layout", "_first"), file)
    fields = F.split(F.coalesce(line, F.lit("")), "\t", -1)
    return both.where((F.col("layout") == "pairs") | (F.col(row_ord) > F.col("_first"))).select(file, "layout", *(F.get(fields, F.lit(k)).alias(name) for k, name in enumerate(header)))


def missing(listed: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """The listed rows whose key isn't there; null keys are never there."""
    return listed.join(there.select(key).distinct(), key, "left_anti").select(*listed.columns)


def first_copies(items: DataFrame, checksum: str, order: list[str]) -> DataFrame:
    """The first item of each checksum and n_copies; items without a checksum are left out."""
    known = items.where(F.col(checksum).isNotNull())
    counts = known.groupBy(checksum).agg(F.count("*").alias("n_copies"))
    # both sides have one row a checksum
    return one_of_each(known, [checksum], order, last=False).join(counts, checksum)


def new_copies(items: DataFrame, done: DataFrame, checksum: str, order: list[str]) -> DataFrame:
    """The first item of each checksum that isn't among the done ones; items without a checksum are
    left out. One item a checksum is left before the join, so a hot one costs nothing."""
    first = one_of_each(items.where(F.col(checksum).isNotNull()), [checksum], order, last=False)
    return first.join(done.select(checksum).where(F.col(checksum).isNotNull()).distinct(), checksum, "left_anti").select(*items.columns)


def keyed_update(manifest: DataFrame, updates: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """manifest with the columns' new values where the last update of its key has one; the other
    values stay. Updates without a row are what missing() finds."""
    last = one_of_each(updates.where(F.col(key).isNotNull()).select(key, *order, *columns), [key], order)
    new = last.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = manifest.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(*((F.coalesce(F.nullif(f"_{c}", F.lit("")), F.col(c)).alias(c) if c in columns else F.col(c)) for c in manifest.columns))


def delimiter_faults(rows: DataFrame, row_id: list[str], columns: list[str]) -> DataFrame:
    """row_id and column of every value that a tab-separated file can't hold."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in columns)))
    return rows.select(*row_id, each.alias("e")).where(F.col("e.v").rlike(r"[\t\r\n]")).select(*row_id, "e.column_name")


def slugged(items: DataFrame, folder: str, text: str, order: str) -> DataFrame:
    """items with name: the slug of the text if no item before it in its folder, by order (an
    integer), has that name; else the slug with the next number from 2 on that makes a new name.

    Names can only meet where a slug is another one with numbers behind it. Slugs without such
    others are numbered by spans, however many items they have. The others are read in order, a
    family (slugs alike but for the numbers) being one task's, which keeps a counter a slug and no
    items; the sort before it spills.
    """
    named = items.withColumns({"_slug": slugify(F.coalesce(text, F.lit(""))), "_folder": F.coalesce(F.col(folder).cast("string"), F.lit(""))})
    named = named.withColumn("_family", F.regexp_replace("_slug", "(?:-[0-9]+)+$", ""))
    slugs = named.groupBy("_folder", "_family", "_slug").agg(F.lit(1).alias("_one"))
    mixed = slugs.groupBy("_folder", "_family").agg(F.count("*").alias("_slugs")).where("_slugs > 1").drop("_slugs")
    alone = named.join(mixed, ["_folder", "_family"], "left_anti")
    numbered = running_number(alone, ["_folder", "_slug"], order, "_n")
    first = numbered.withColumn("name", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), F.col("_n").cast("string"))))
    shared = named.join(mixed, ["_folder", "_family"], "left_semi")
    keys = [c for c, kind in items.dtypes if not kind.startswith("map") and c != order]
    ordered = shared.repartition("_folder", "_family").sortWithinPartitions("_folder", "_family", order, *keys)
    schema = StructType([*shared.schema.fields, StructField("name", StringType())])
    later = ordered.mapInPandas(_count_on, schema)
    columns = [*items.columns, "name"]
    return first.select(*columns).unionByName(later.select(*columns))


def _count_on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names of items sorted by family: those taken as they are, and of each slug the next number."""
    family, taken, following = None, set(), {}
    for frame in frames:
        names = []
        for where, slug in zip(zip(frame["_folder"], frame["_family"]), frame["_slug"]):
            if where != family:
                family, taken, following = where, set(), {}

            def used(name: str) -> bool:
                base, _, number = name.rpartition("-")
                counted = number.isdigit() and not (number.startswith("0")) and 2 <= int(number) < following.get(base, 2)
                return name in taken or counted

            if not used(slug):
                taken.add(slug)
                names.append(slug)
                continue
            n = following.get(slug, 2)
            while f"{slug}-{n}" in taken:
                n += 1
            following[slug] = n + 1
            names.append(f"{slug}-{n}")
        yield frame.assign(name=names)


def with_empty_groups(groups: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """key and n_items of every group, also those without items. Items are counted first."""
    counts = items.groupBy(key).agg(F.count("*").alias("n_items"))
    return groups.select(key).distinct().join(counts, key, "left").fillna(0, ["n_items"])


def grouped_items(groups: DataFrame, items: DataFrame, key: str, order: str) -> DataFrame:
    """A row for each item with its place in its group (from 1, by order, an integer), and one with
    nulls for each group without items. Items of unknown or no groups are left out; large groups
    are numbered by spans and never gathered."""
    known = groups.select(F.col(key).alias("_key")).where(F.col(key).isNotNull()).distinct()
    numbered = running_number(items.where(F.col(key).isNotNull()), [key], order, "place")
    return known.join(numbered, F.col("_key") == F.col(key), "left").withColumn(key, F.col("_key")).drop("_key")


def plan(listed: DataFrame, there: DataFrame, key: str, folder: Column, seconds: int = 5) -> DataFrame:
    """folder, n_listed, n_missing and seconds to fetch what is missing."""
    known = there.select(F.col(key).alias("_there")).distinct()
    joined = listed.join(known, F.col(key) == F.col("_there"), "left")
    grouped = joined.groupBy(folder.alias("folder")).agg(F.count("*").alias("n_listed"), F.count_if(F.col("_there").isNull()).alias("n_missing"))
    return grouped.withColumn("seconds", F.col("n_missing") * seconds)


def verdicts(results: DataFrame) -> DataFrame:
    """results with passed and outcome of a probe: an error fails, a status under 400 passes, a
    capture passes if there is one."""
    passed = F.when(F.col("error").isNotNull(), False).when(F.col("kind") == "capture", F.col("closest").isNotNull()).otherwise(F.coalesce(F.col("status") < 400, F.lit(False)))
    outcome = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("kind") == "capture", F.when(passed, "captured").otherwise("no capture")).otherwise(F.coalesce(F.col("status").cast("string"), F.lit("no answer")))
    return results.withColumns({"passed": passed, "outcome": outcome})


def report(judged: DataFrame, target: str, cited_in: str) -> DataFrame:
    """The report's rows: each target once with its outcome and in how many places it is cited."""
    return judged.groupBy("passed", "outcome", target).agg(F.count("*").alias("n_cited"), F.min(cited_in).alias("first_cited_in"))


def fetch_state(log: DataFrame, stream: str, seq: str, outcome: str, most: int = 5, width: int = 65_536) -> DataFrame:
    """Every attempt with failures, the throttled answers in a row up to it (a fetched file sets
    them back), and stopped, whether there were `most` of them by then: a run that stopped stays
    so. seq is an integer; a stream is cut in spans of `width` of it, so a hot one isn't a task."""
    known = log.withColumn("_fetched", (F.col(outcome) == "fetched").cast("int"))
    blocks = running_sum(known, [stream], seq, "_fetched", "_block", width).withColumn("_throttled", (F.col(outcome) == "throttled").cast("int"))
    counted = running_sum(blocks, [stream, "_block"], seq, "_throttled", "failures", width).withColumn("_full", (F.col("failures") >= most).cast("int"))
    stopped = running_sum(counted, [stream], seq, "_full", "_stops", width).withColumn("stopped", F.col("_stops") > 0)
    return stopped.select(*log.columns, "failures", "stopped")


def versions(tags: DataFrame) -> DataFrame:
    """place and row of the versions table, by date and row text; seed- tags are left out. files
    are the changed pages, without README and CHANGES, sorted and once each."""
    pages = F.array_sort(F.array_distinct(F.filter("files", lambda f: f.endswith(".md") & ~f.rlike("(README|CHANGES)"))))
    row = F.concat(F.lit("| "), F.col("day").cast("string"), F.lit(" | "), F.col("tag"), F.lit(" | "), F.col("subject"), F.lit(" | "), F.array_join(pages, ", "), F.lit(" |"))
    kept = tags.where(~F.col("tag").startswith("seed-")).select("day", row.alias("row_text"))
    return kept.select(F.row_number().over(Window.orderBy("day", "row_text")).alias("place"), "row_text")


def signed_limit(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows by order; with n below 0 all but the last -n, found by a top-k of those."""
    if n >= 0:
        return rows.orderBy(*order).limit(n)
    ends = rows.orderBy(*(F.col(c).desc() for c in order)).limit(-n)
    return rows.join(ends.select(*order), order, "left_anti")
