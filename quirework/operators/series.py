"""Editions of a glossary lined up over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import normalise_definition, normalise_term
from quirework.operators.ordered import one_of_each
from quirework.session import written

#: The year of an edition without one: it sorts last.
NO_YEAR = 9999


def edition_label(edition: Column) -> Column:
    """year, suffix and label of an edition named kind-YYYY."""
    year = F.regexp_extract(edition, r"-([0-9]{4})$", 1)
    known = year != ""
    suffix = F.when(known, F.regexp_replace(edition, r"-[0-9]{4}$", "")).otherwise(edition)
    return F.struct(
        F.when(known, year.try_cast("int")).otherwise(NO_YEAR).alias("year"),
        suffix.alias("suffix"),
        F.when(known, F.concat(year, F.lit("-"), suffix)).otherwise(edition).alias("label"),
    )


def editions(entries: DataFrame) -> DataFrame:
    """edition, year, suffix, label and position (from 1) of every edition. There are as many rows
    as editions, so the one window over them is small."""
    known = entries.select("edition").where("edition is not null").distinct().withColumn("e", edition_label(F.col("edition")))
    order = Window.orderBy("e.year", "e.suffix")
    return known.select("edition", "e.year", "e.suffix", "e.label", F.row_number().over(order).alias("position"))


def series(entries: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """One row for each edition and normalised term, the later row of an edition winning: edition,
    position, key, term, definition. Rows whose term or edition is null, or whose term normalises
    to nothing, are left out."""
    keyed = entries.select("edition", normalise_term(F.col("term"), aliases).alias("key"), "file_ord", "row_ord", "entry_id", "term", "definition")
    kept = one_of_each(keyed.where("key <> '' and edition is not null"), ["edition", "key"], ["file_ord", "row_ord", "entry_id"])
    # one row an edition: a dimension of the size of the list of editions
    return kept.join(F.broadcast(editions(entries).select("edition", "position", "year")), "edition")


def recurrence(lined: DataFrame) -> DataFrame:
    """key, first spelling, n_editions, kind (recurring or one-off) and the labels of its years."""
    first = F.min(F.struct("position", "term")).alias("first")
    years = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("position", "year"))), lambda x: x["year"].cast("string")), ", ")
    grouped = lined.groupBy("key").agg(first, F.count("*").alias("n_editions"), years.alias("years"))
    kind = F.when(F.col("n_editions") > 1, "recurring").otherwise("one-off")
    return grouped.select("key", F.col("first.term").alias("first_spelling"), "n_editions", kind.alias("kind"), "years")


def display_order(lined: DataFrame) -> DataFrame:
    """key, kind and place (from 1 in its kind): recurring and one-off terms by their first spelling
    whatever the case; equal ones in the order in which they were first seen. Numbered after one
    sort over ranges, so no kind is one task's."""
    first = lined.groupBy("key").agg(F.min(F.struct("position", "file_ord", "row_ord", "term")).alias("first"), F.count("*").alias("n"))
    kind = F.when(F.col("n") > 1, "recurring").otherwise("one-off")
    named = first.select("key", kind.alias("kind"), F.lower("first.term").alias("shown"), F.struct("first.position", "first.file_ord", "first.row_ord").alias("seen"))
    order = ["kind", "shown", "seen", "key"]
    # one row a key, cut in even ranges; what a range counts is one row a range and kind
    ranged = written(named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "display-order")
    counts = ranged.groupBy("kind", "_part").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("kind").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("kind", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("kind", "_part").orderBy("shown", "seen", "key"))
    return ranged.withColumn("_own", own).join(offsets, ["kind", "_part"]).select("key", "kind", (F.col("_own") + F.col("_before")).alias("place"))


def one_offs_by_year(lined: DataFrame) -> DataFrame:
    """year, n_terms and terms (first spellings in order) of the terms that one edition alone has."""
    once = lined.groupBy("key").agg(F.count("*").alias("n"), F.min("year").alias("year"), F.min(F.struct("position", "term"))["term"].alias("term")).where("n = 1")
    return once.groupBy("year").agg(F.count("*").alias("n_terms"), F.array_join(F.array_sort(F.collect_list("term")), "; ").alias("terms"))


def neighbour_changes(lined: DataFrame) -> DataFrame:
    """position (of the later edition), key and change (added, dropped or reworded) between each
    edition and the one before. A definition is reworded if its normalised form differs; null
    equals only null. One shuffle: each row stands for its edition and, one on, for the one
    before."""
    last = lined.agg(F.max("position").alias("last"))
    facts = lined.select("position", "key", normalise_definition(F.col("definition")).alias("words"))
    new = facts.where("position > 1").select("position", "key", F.lit(True).alias("is_new"), "words")
    old = facts.select((F.col("position") + 1).alias("position"), "key", F.lit(False).alias("is_new"), "words")
    old = old.join(F.broadcast(last), F.col("position") <= F.col("last")).drop("last")  # one row
    both = new.unionByName(old).groupBy("position", "key").agg(
        F.bool_or("is_new").alias("in_new"), F.bool_or(~F.col("is_new")).alias("in_old"),
        F.max(F.when(F.col("is_new"), F.col("words"))).alias("new_words"), F.max(F.when(~F.col("is_new"), F.col("words"))).alias("old_words"),
    )
    change = (
        F.when(~F.col("in_old"), "added").when(~F.col("in_new"), "dropped")
        .when(~F.col("new_words").eqNullSafe(F.col("old_words")), "reworded")
    )
    return both.select("position", "key", change.alias("change")).where("change is not null")


def pair_report(lined: DataFrame, old: str, new: str) -> DataFrame:
    """key, change, old and new definition of two named editions; an edition that isn't there is an
    error that names those that are."""
    known = sorted(r[0] for r in lined.select("edition").distinct().collect())
    if missing := [e for e in (old, new) if e not in known]:
        raise ValueError(f"no edition {missing}; there are {known}")
    sides = [lined.where(F.col("edition") == e).select("key", F.lit(True).alias(f"in_{s}"), F.col("definition").alias(f"{s}_definition")) for e, s in ((old, "old"), (new, "new"))]
    both = sides[0].join(sides[1], "key", "full_outer")
    same = normalise_definition(F.col("old_definition")).eqNullSafe(normalise_definition(F.col("new_definition")))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "dropped").when(~same, "reworded").otherwise("same")
    return both.select("key", change.alias("change"), "old_definition", "new_definition")
