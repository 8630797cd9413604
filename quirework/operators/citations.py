"""Citations: extracted from text, resolved against the catalog, numbered on their page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import outside_fences
from quirework.operators.ordered import running_number
from quirework.operators.orphans import GROUP_ROWS, with_spans
from quirework.operators.skew import join_keyed, small
from quirework.session import written

# The syntax of citations and of the page in a locator.
#: [@key locator]; the locator keeps its leading white space and ends at the first bracket.
CITATION = r"\[@([A-Za-z0-9][A-Za-z0-9._:-]*)((?:\s+[^\]]*)?)\]"
#: A page number in a locator, as a word of its own: p.14, p 14, p14.
PAGE = r"\bp\.?\s*(\d+)"


def extract(pages: DataFrame, page: str, text: str) -> DataFrame:
    """page, pos (from 0 in its page), key and locator of every citation outside fenced code. Null
    texts have none; the columns of pages besides are not carried."""
    pieces = outside_fences(F.col(text))
    found = lambda group: F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(CITATION), F.lit(group))))
    pairs = F.arrays_zip(found(1).alias("key"), found(2).alias("locator"))
    return pages.select(F.col(page), F.posexplode(pairs).alias("pos", "c")).select(page, "pos", F.col("c.key").alias("key"), F.col("c.locator").alias("locator"))


def collapsed(locator: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(locator, F.lit("")), r"\s+", " "))


def named_part(parts: Column, locator: Column) -> Column:
    """The name of the part that a locator names as whole words, whatever the case; of several the
    longest, of equally long the one declared first. Null if none."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(locator, F.lit(""))), F.lit(" "))

    def named(name: Column) -> Column:
        # split at the name: some place has no letter or digit on either side
        pieces = F.split(padded, F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.lower(name), F.lit(r"\E(?![a-z0-9])")), -1)
        return F.size(pieces) > 1

    found = F.filter(F.map_keys(parts), named)
    longest = F.array_max(F.transform(found, lambda n: F.length(n)))
    return F.try_element_at(F.filter(found, lambda n: F.length(n) == longest), F.lit(1))


def resolve(citations: DataFrame, catalog: DataFrame, key: str = "cite_key", locator: str = "locator") -> DataFrame:
    """citations with url, label, hover_title and found by the catalog (one row a key; its columns
    source_key, title, date_raw, file_format, url, parts, held_by).

    A locator may name a part; a PDF (by format or address) gets the page the locator names; a
    source without address says who holds it. An unknown key stays, with found false; a null or
    empty key is unknown. Both sides' other columns may clash: the catalog's are renamed. Uses of
    a key are counted first, so a key with a third of all rows is joined without being moved.
    """
    named = {"title": "_title", "date_raw": "_date", "file_format": "_format", "url": "_url", "parts": "_parts", "held_by": "_held_by"}
    entry = catalog.select(F.col("source_key").alias("_key"), *(F.col(c).alias(n) for c, n in named.items()))
    rows = citations.drop("url", "label", "hover_title", "found").withColumn("_key", F.coalesce(key, F.lit("")))
    uses = rows.groupBy("_key").agg(F.count("*").alias("_n"))
    known = uses.join(entry.withColumn("_known", F.lit(True)), "_key", "left")
    total = citations.count()
    joined = join_keyed(rows, known, "_key", "_n", total)
    place = F.trim(F.coalesce(locator, F.lit("")))
    part = named_part(F.coalesce("_parts", F.create_map().cast("map<string,string>")), place)
    base = F.coalesce(F.try_element_at("_parts", part), F.col("_url"))
    page = F.nullif(F.regexp_extract(place, PAGE, 1), F.lit(""))
    is_pdf = F.coalesce(F.col("_format") == "pdf", F.lit(False)) | F.lower(base).endswith(".pdf")
    url = F.when(is_pdf & page.isNotNull(), F.concat(base, F.lit("#page="), page)).otherwise(base)
    title = F.coalesce(F.col("_title"), F.col("_key"))
    suffix = F.when(place == "", "").otherwise(F.concat(F.lit(", "), place))
    held = F.when(base.isNull() & (F.coalesce("_held_by", F.lit("")) != ""), F.concat(F.lit(" (held by "), F.col("_held_by"), F.lit(")"))).otherwise("")
    unknown = F.concat(F.lit("[@"), F.col("_key"), F.when(place == "", "").otherwise(F.concat(F.lit(" "), place)), F.lit("] (unknown source key)"))
    dated = F.when(F.col("_date").isNull(), "").otherwise(F.concat(F.lit(" ("), F.col("_date"), F.lit(")")))
    there = F.col("_known").isNotNull()
    return joined.select(
        *(c for c in citations.columns if c not in ("url", "label", "hover_title", "found")),
        F.when(there, url).alias("url"),
        F.when(there, F.concat(title, suffix, held)).otherwise(unknown).alias("label"),
        F.when(there, F.concat(title, dated)).otherwise("unknown source key").alias("hover_title"),
        there.alias("found"),
    )


def references(citations: DataFrame, page: str, pos: str, key: str, locator: str) -> DataFrame:
    """One row for each page and distinct (key, collapsed locator): number by first appearance,
    first_pos, n_uses. The uses are aggregated before they are numbered."""
    place = collapsed(F.col(locator))
    # equal positions of two references go by key and locator
    each = citations.where(F.col(key).isNotNull()).groupBy(page, F.col(key).alias("key"), place.alias("locator")).agg(F.min(pos).alias("first_pos"), F.count("*").alias("n_uses"))
    return running_number(each.select(page, "first_pos", "key", "locator", "n_uses"), [page], "first_pos", "number")


def uses(citations: DataFrame, page: str, pos: str, key: str, locator: str, row_id: str) -> DataFrame:
    """Every citation with its ordinal among the uses of its reference on the page."""
    rows = citations.where(F.col(key).isNotNull()).select(row_id, page, pos, F.col(key).alias("key"), collapsed(F.col(locator)).alias("locator"))
    return running_number(rows.select(pos, row_id, page, "key", "locator"), [page, "key", "locator"], pos, "use_no")


def backlinks(n_uses: Column) -> Column:
    """The marks of a reference's back links: ^ for a single use, else a to z, then numbers."""
    marks = F.transform(F.sequence(F.lit(1), n_uses.cast("int")), lambda n: F.when(n <= 26, F.char(n + 96)).otherwise(n.cast("string")))
    return F.when(n_uses == 1, "^").otherwise(F.array_join(marks, " "))


def longest_prefix(texts: DataFrame, row_id: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """row_id, and the longest of the terms, of two words or more, that the text starts with at a
    space, whatever the case (ties: the first in order).

    Each text offers its prefixes that end at one of the first spaces, as many as the longest term
    has words, for an equal join; no text is held against all terms.
    """
    known = terms.where(F.contains(term, F.lit(" "))).select(F.lower(term).alias("_prefix"), F.col(term).alias("term")).groupBy("_prefix").agg(F.min("term").alias("term"))
    most = known.agg(F.max(F.size(F.split("_prefix", " ")))).collect()[0][0] or 0
    words = F.split(F.lower(F.col(text)), " ", most + 1)
    ends = F.when(F.size(words) > 2, F.sequence(F.lit(2), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    offered = texts.where(F.col(text).isNotNull()).select(row_id, F.explode(F.transform(ends, lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("_prefix"))
    return offered.join(known, "_prefix").groupBy(row_id).agg(F.max_by("term", F.length("_prefix")).alias("term"))


def nearest_capture(cited: DataFrame, captures: DataFrame, key: str, cited_at: str, captured_at: str, row_id: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """row_id and the nearest time at which its key was captured (ties: the earlier); rows whose
    key was never captured are left out.

    Both sides are one stream in time; the last capture before and the first after are the only
    candidates, so nothing is paired. Captures of a key are one row a time. A key of more than
    group_rows rows is cut into even spans of time; what lies before and after a span is one row a
    span. Null keys and times match nothing.
    """
    there = lambda df, at: df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.lit("").alias("parent"), F.col(key).alias("key"), F.col(at).alias("at"))
    asked = cited.where(F.col(key).isNotNull() & F.col(cited_at).isNotNull()).select(F.lit("").alias("parent"), F.col(key).alias("key"), F.col(cited_at).alias("at"), F.col(row_id).alias("row_id"))
    taken = there(captures, captured_at).distinct().withColumn("row_id", F.lit(None).cast("bigint"))
    stream = written(asked.unionByName(taken), "capture-stream")
    hot = written(stream.groupBy("parent", "key").agg(F.count("*").alias("n")).where(F.col("n") > group_rows), "capture-hot")
    cut = with_spans(stream, hot, group_rows)
    capture = F.when(F.col("row_id").isNull(), F.col("at"))
    own = Window.partitionBy("key", "span")
    inside = cut.withColumn("_before", F.max(capture).over(own.orderBy("at"))).withColumn("_after", F.min(capture).over(own.orderBy(F.col("at").desc())))
    spans = cut.where("bounds is not null").groupBy("key", "span").agg(F.max(capture).alias("last"), F.min(capture).alias("first"))
    order = Window.partitionBy("key").orderBy("span")
    handed = spans.select(
        F.col("key").alias("_key"), F.col("span").alias("_span"), F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.min("first").over(Window.partitionBy("key").orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"),
    )
    near = inside.join(small(written(handed, "capture-spans")), (F.col("key") == F.col("_key")) & (F.col("span") == F.col("_span")), "left")
    near = near.withColumns({"before": F.coalesce("_before", "_earlier"), "after": F.coalesce("_after", "_later")})
    micro = lambda c: F.unix_micros(c)
    closer = (micro(F.col("after")) - micro(F.col("at"))) < (micro(F.col("at")) - micro(F.col("before")))
    best = F.when(F.col("before").isNull() | closer, F.col("after")).otherwise(F.col("before"))
    return near.where("row_id is not null").select("row_id", best.alias("captured_at")).where("captured_at is not null")
