"""Timelines: blocks of "Label: span; span" lines parsed to segments, and their geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.operators.ordered import running_sum

ONGOING = "now|today|current|present|ongoing"
SPAN = rf"(?i)^(\??\s*\d{{4}}\s*(?:-\s*(?:\d{{4}}|{ONGOING})?)?\s*\??)(?:\s+(.*))?$"


def _year(word: Column, this_year: int) -> Column:
    plain = F.lower(F.trim(word))
    return F.when(plain.rlike(rf"^({ONGOING})?$"), this_year).otherwise(plain.try_cast("int"))


def span(text: Column, this_year: int) -> Column:
    """first_year, last_year, fades_in, fades_out, is_open, is_point and is_reversed of a span such
    as ?1993-2013?; years are null where they can't be read."""
    bare = F.trim(text)
    fades_in, rest = bare.startswith("?"), F.regexp_replace(bare, r"^\?+", "")
    fades_out, years = rest.endswith("?"), F.trim(F.regexp_replace(rest, r"\?+$", ""))
    dash = F.contains(years, F.lit("-"))
    last_word = F.regexp_replace(years, r"^[^-]*-", "")
    first = _year(F.split(years, "-")[0], this_year)
    last = F.when(dash, _year(last_word, this_year)).otherwise(first)
    is_open = dash & F.lower(F.trim(last_word)).rlike(rf"^({ONGOING})?$")
    return F.struct(
        first.alias("first_year"), last.alias("last_year"), fades_in.alias("fades_in"), fades_out.alias("fades_out"),
        is_open.alias("is_open"), (~dash & ~fades_in & ~fades_out).alias("is_point"), (last < first).alias("is_reversed"),
    )


def lines(blocks: DataFrame, block: str, body: str) -> DataFrame:
    """block, line_no, line and kind (axis, group, row or bad) of the lines that aren't blank or
    comments."""
    each = blocks.select(block, F.posexplode(F.split(F.col(body), r"\r\n|\n|\r")).alias("line_no", "raw")).withColumn("line", F.trim("raw"))
    kept = each.where("line <> '' and not startswith(line, '#')")
    is_group = F.col("line").rlike(r"(?i)^(?:group\s*:\s*.+|\[\s*[^\]]+\s*\])\s*$")
    kind = F.when(F.col("line").rlike(r"(?i)^(from|to)\s*:\s*\S*$"), "axis").when(is_group, "group").when(F.contains("line", F.lit(":")), "row").otherwise("bad")
    return kept.select(block, "line_no", "line", kind.alias("kind"))


def segments(blocks: DataFrame, block: str, body: str, this_year: int) -> DataFrame:
    """One row for each segment: block, line_no, segment_no, group_no (0 before any heading),
    is_top_level, label, text, is_marker and the span's columns. Segments whose years can't be
    read, and lines without a colon, are left out; lines() has them as bad. this_year is what
    "now" means, so the result doesn't depend on the day."""
    known = lines(blocks, block, body)
    grouped = running_sum(known.withColumn("_g", F.when(F.col("kind") == "group", 1).otherwise(0)), [block], "line_no", "_g", "group_no", 4096)
    rows = grouped.where("kind = 'row'")
    named = r"^\[\s*([^\]]+?)\s*\]\s*:"
    top = F.col("line").rlike(named) | (F.col("group_no") == 0)
    line = F.regexp_replace("line", named, "$1:")
    marks = line.startswith("*")
    line = F.when(marks, F.trim(F.regexp_replace(line, r"^\*", ""))).otherwise(line)
    label, rest = F.trim(F.regexp_extract(line, r"^([^:]*):", 1)), F.trim(F.regexp_replace(line, r"^[^:]*:", ""))
    pieces = rows.select(block, "line_no", "group_no", top.alias("is_top_level"), marks.alias("_marks"), label.alias("label"), F.posexplode(F.filter(F.transform(F.split(rest, r";\s*|,\s*(?=\??\s*\d{4})"), lambda x: F.trim(x)), lambda x: x != "")).alias("segment_no", "piece"))
    turned = F.regexp_replace("piece", r"^(.*?):\s*(\??\s*\d{4}.*)$", "$2 $1")
    piece = F.when(F.col("piece").rlike(r"^\??\s*\d{4}"), F.col("piece")).otherwise(turned)
    made = pieces.withColumn("s", span(F.regexp_extract(piece, SPAN, 1), this_year)).withColumn("text", F.btrim(F.trim(F.regexp_extract(piece, SPAN, 2)), F.lit('"')))
    read = made.where(piece.rlike(SPAN) & F.col("s.first_year").isNotNull() & F.col("s.last_year").isNotNull())
    return read.select(block, "line_no", "segment_no", "group_no", "is_top_level", "label", "text", (F.col("s.is_point") | F.col("_marks")).alias("is_marker"), "s.*")


def axes(blocks: DataFrame, block: str, body: str, segmented: DataFrame, this_year: int) -> DataFrame:
    """block, start_year, end_year, step and ticks: by the from: and to: lines, else the earliest
    and latest year; at least two years; ticks every 5 years, every 10 over more than 45."""
    told = lines(blocks, block, body).where("kind = 'axis'")
    word = F.regexp_extract("line", r":\s*(\S*)$", 1)
    setting = F.lower(F.regexp_extract("line", r"(?i)^(from|to)", 1))
    asked = told.groupBy(block).agg(
        F.max_by(F.when(setting == "from", _year(word, this_year)), F.when(setting == "from", F.col("line_no"))).alias("_from"),
        F.max_by(F.when(setting == "to", _year(word, this_year)), F.when(setting == "to", F.col("line_no"))).alias("_to"),
    )
    found = segmented.groupBy(block).agg(F.min("first_year").alias("_min"), F.max("last_year").alias("_max"))
    both = found.join(asked, block, "left").select(block, F.coalesce("_from", "_min").alias("start_year"), F.coalesce("_to", "_max").alias("_end"))
    both = both.select(block, "start_year", F.greatest("_end", F.col("start_year") + 1).alias("end_year"))
    step = F.when(F.col("end_year") - F.col("start_year") + 1 <= 45, 5).otherwise(10)
    first = F.ceil(F.col("start_year") / step).cast("int") * step
    return both.withColumn("step", step).withColumn("ticks", F.when(first <= F.col("end_year"), F.sequence(first, F.col("end_year"), step)).otherwise(F.array().cast("array<int>")))


def percent_across(year: Column, start: Column, end: Column) -> Column:
    return (year - start) * 100.0 / (end + 1 - start)


def geometry(segmented: DataFrame, axis: DataFrame, block: str) -> DataFrame:
    """segmented with left_percent, width_percent (null for markers), is_clipped, is_alternate and
    dates. A bar is cut at both ends of the axis; a marker stands in the middle of its year."""
    # one row a block
    both = segmented.join(axis.select(block, "start_year", "end_year"), block)
    start, end = F.col("start_year"), F.col("end_year")
    drawn = F.greatest("first_year", start)
    left = percent_across(drawn, start, end)
    bar_width = percent_across(F.least("last_year", end) + 1, start, end) - left
    point = percent_across(F.col("first_year"), start, end) + F.lit(50.0) / (end + 1 - start)
    one = (F.col("first_year") == F.col("last_year")) & ~F.col("is_open")
    until = F.when(F.col("is_open"), "now").otherwise(F.col("last_year").cast("string"))
    dates = F.when(F.col("is_marker") | one, F.col("first_year").cast("string")).otherwise(F.concat(F.col("first_year").cast("string"), F.lit("–"), until))
    return both.select(
        *segmented.columns, F.when(F.col("is_marker"), point).otherwise(left).alias("left_percent"), F.when(~F.col("is_marker"), bar_width).alias("width_percent"),
        (~F.col("is_marker") & (drawn > F.col("first_year"))).alias("is_clipped"), (F.col("segment_no") % 2 == 1).alias("is_alternate"), dates.alias("dates"),
    )


def tight_rows(segmented: DataFrame, axis: DataFrame, block: str) -> DataFrame:
    """block, line_no and is_tight of each row of a timeline: several segments, one of which is a
    bar that shows under four years of the axis."""
    both = segmented.join(axis.select(block, "start_year"), block)
    shown = F.col("last_year") - F.greatest("first_year", "start_year") + 1
    return both.groupBy(block, "line_no").agg(((F.count("*") > 1) & F.bool_or((shown < 4) & ~F.col("is_point"))).alias("is_tight"))
