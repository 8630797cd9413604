"""Shapes of letters against a reference: which character a shape is, and which fonts are broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.ordered import one_of_each


def most_common(rows: DataFrame, keys: list[str], value: str, count: str, order: str) -> DataFrame:
    """The value with the largest sum of counts of each group, with n; of equal ones the first by
    order."""
    sums = rows.groupBy(*keys, value).agg(F.sum(count).alias("n"), F.min(order).alias("_first"))
    return sums.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col("_first"))).alias(value), F.max("n").alias("n"))


def judge(glyphs: DataFrame, reference: DataFrame) -> DataFrame:
    """font, n_matched, n_agreeing and broken. glyphs: font, shape, extracted, n, ord; reference:
    shape, meant, ord, of which the first of a shape wins. A font is broken if at least three of
    its shapes are known and under half of those agree. Empty shapes are left out."""
    known = one_of_each(reference.where("shape <> ''"), ["shape"], ["ord"], last=False).select("shape", "meant")
    read = most_common(glyphs.where("shape <> ''"), ["font", "shape"], "extracted", "n", "ord")
    matched = read.join(known, "shape")
    agree = F.count_if(F.col("extracted").eqNullSafe(F.col("meant")))
    judged = matched.groupBy("font").agg(F.count("*").alias("n_matched"), agree.alias("n_agreeing"))
    return judged.withColumn("broken", (F.col("n_matched") >= 3) & (F.col("n_agreeing") * 2 < F.col("n_matched")))


def report(judged: DataFrame) -> DataFrame:
    """judged with place (from 1): broken fonts first, then by name."""
    return judged.withColumn("place", F.row_number().over(Window.orderBy(~F.col("broken"), "font")))


def commonest(glyphs: DataFrame, most: int = 120) -> DataFrame:
    """font, shape, n and place of each font's shapes that are read most often, at most `most` of
    them: a report that is a list of that length. Equal ones go by shape."""
    sums = glyphs.where("shape <> ''").groupBy("font", "shape").agg(F.sum("n").alias("n"))
    # a font has as many rows here as it has shapes
    place = F.row_number().over(Window.partitionBy("font").orderBy(F.col("n").desc(), "shape"))
    return sums.withColumn("place", place).where(F.col("place") <= most)


def in_place(glyphs: DataFrame, standard: DataFrame, least: int = 3) -> DataFrame:
    """font, n_checked, n_in_place and follows: whether at least nine in ten of the glyphs that the
    standard order (glyph, meant) names, blanks aside, stand where it puts them, and at least
    `least` could be checked. glyphs: font, glyph, meant, one row a glyph."""
    checked = glyphs.where("meant <> ' '").join(standard.withColumnRenamed("meant", "_there"), "glyph")
    sums = checked.groupBy("font").agg(F.count("*").alias("n_checked"), F.count_if(F.col("meant") == F.col("_there")).alias("n_in_place"))
    return sums.withColumn("follows", (F.col("n_checked") >= least) & (F.col("n_in_place") * 10 >= F.col("n_checked") * 9))
