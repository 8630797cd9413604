"""Queries over laid-out lines and timelines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as X
from quirework.operators import layouts as L
from quirework.operators import timelines as T
from quirework.operators.ordered import next_text as following_text
from quirework.sources.tables import table

FURNITURE = [r"-? ?\d{1,3} ?-?", r"Page \d+( of \d+)?", r"\[\d+\]", r"Printed for .*"]
THIS_YEAR = 2024
#: Least width of a column of a page's wide lines.
WIDTH = 40


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return L.positions(table(spark, folder, "page_lines"))


def furniture_filter(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "page_lines")
    return lines.where(~X.is_furniture(F.coalesce("text", F.lit("")), FURNITURE)).select("line_id")


def term_heuristic(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "page_lines").where("text is not null")
    return lines.select("line_id", X.looks_like_term(F.col("text")).alias("like_term"))


def next_text_line(spark: SparkSession, folder: str) -> DataFrame:
    led = following_text(_lines(spark, folder), ["doc"], "position", "text", "following", L.SPAN)
    return led.select("line_id", "following", X.indent_width(F.col("following")).alias("indent"))


def _entries(entries: DataFrame) -> DataFrame:
    return entries.select("doc", "entry_no", "term", "definition", "n_lines")


def parse_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Minutes as numbered entries: every line of theirs that is numbered 1 follows a term."""
    return _entries(L.read_numbered(_numbered_lines(spark, folder)))


def _numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Page lines with a "1. " put before the lines of continued text after a heading-like line."""
    lines = _lines(spark, folder)
    marked = F.when((F.col("position") % 3 == 0) & (F.trim("text") != ""), F.concat(F.lit("1. "), F.trim("text"))).otherwise(F.col("text"))
    return lines.withColumn("text", marked)


def parse_indent(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(L.read_indent(_lines(spark, folder)))


def parse_para(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(L.read_para(_lines(spark, folder)))


def parse_inline(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(L.draft_entries(_lines(spark, folder), "inline"))


def parse_colon(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(L.draft_entries(_lines(spark, folder), "colon"))


def parse_plain(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(L.draft_entries(_lines(spark, folder), "plain"))


def layout_argmax(spark: SparkSession, folder: str) -> DataFrame:
    return L.layout_scores(_lines(spark, folder))


def cursor_locate(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder)
    return L.locate(L.read_plain(lines), lines)


def cursor_locate_colon(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that open their line, each searched on from the one before."""
    lines = _lines(spark, folder)
    return L.locate(L.read_colon(lines), lines, starts_line=True)


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's columns side by side, as a scanner that keeps the layout gives them, and where
    the second and third begin: a column is as wide as its longest line and two spaces, at least
    WIDTH."""
    lines = table(spark, folder, "page_lines").where("col_no <= 3")
    column = lambda n: F.coalesce(F.max(F.when(F.col("col_no") == n, F.rtrim("text"))), F.lit(""))
    rows = lines.groupBy("doc", "page", "line_no").agg(column(1).alias("a"), column(2).alias("b"), column(3).alias("c"))
    widest = lambda c: F.greatest(F.max(F.length(c)) + 2, F.lit(WIDTH))
    # one row a page; ids of pages may be null
    widths = rows.groupBy(F.col("doc").alias("_doc"), F.col("page").alias("_page")).agg(widest("a").alias("second_at"), widest("b").alias("_b"))
    wide = rows.join(widths, F.col("doc").eqNullSafe(F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page")))
    line = F.rtrim(F.concat(F.rpad("a", F.col("second_at"), F.lit(" ")), F.rpad("b", F.col("_b"), F.lit(" ")), F.col("c")))
    return wide.select("doc", "page", "line_no", line.alias("line"), "second_at", (F.col("second_at") + F.col("_b")).alias("third_at"))


BOUNDS = ("second_at", "third_at")


def column_cut(spark: SparkSession, folder: str) -> DataFrame:
    pieces = L.cut(F.col("line"), [F.col(b) for b in BOUNDS])
    return _wide(spark, folder).select("doc", "page", "line_no", pieces[0].alias("first"), pieces[1].alias("second"), pieces[2].alias("third"))


def column_cut_indent(spark: SparkSession, folder: str) -> DataFrame:
    made = L.cut_keeping_indent(_wide(spark, folder), ["doc", "page"], "line", [F.col(b) for b in BOUNDS])
    return made.select("doc", "page", "line_no", F.col("pieces")[0].alias("first"), F.col("pieces")[1].alias("second"))


def column_cut_smart(spark: SparkSession, folder: str) -> DataFrame:
    """The wide lines cut at columns that are two characters off, so that words cross them."""
    pieces = L.cut_drifting(F.col("line"), F.array(*(F.col(b) - 2 for b in BOUNDS)))
    return _wide(spark, folder).select("doc", "page", "line_no", pieces[0].alias("first"), pieces[1].alias("second"), pieces[2].alias("third"))


def column_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Where the columns of each page's wide lines start, found from the lines alone."""
    return L.column_starts(_wide(spark, folder), ["doc", "page"], "line").select("doc", "page", F.array_join("starts", ",").alias("starts"))


def assign_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Each segment of the wide lines with its column."""
    each = _wide(spark, folder).select("doc", "page", "line_no", *BOUNDS, F.explode(L.segments(F.col("line"))).alias("s"))
    return each.select("doc", "page", "line_no", F.col("s.start").alias("start"), F.col("s.text").alias("segment"), L.column_of(F.col("s.start"), [0, *map(F.col, BOUNDS)]).alias("column_no"))


def offset_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return L.word_starts(_wide(spark, folder), ["doc", "page"], "line")


def offset_peaks(spark: SparkSession, folder: str) -> DataFrame:
    found = L.peaks(L.word_starts(_wide(spark, folder), ["doc", "page"], "line"), ["doc", "page"], 3, 10)
    return found.select("doc", "page", F.array_join("offsets", ",").alias("offsets"))


def offset_shares(spark: SparkSession, folder: str) -> DataFrame:
    return L.offset_shares(_wide(spark, folder), ["doc", "page"], "line", [35, 40, 60, 80])


def offset_shares_near(spark: SparkSession, folder: str) -> DataFrame:
    """The same, where a word may start up to two characters on."""
    return L.offset_shares(_wide(spark, folder), ["doc", "page"], "line", [35, 40, 60, 80], 3)


def timeline_tight(spark: SparkSession, folder: str) -> DataFrame:
    blocks = _blocks(spark, folder)
    found = T.segments(blocks, "gallery_key", "body", THIS_YEAR)
    return T.tight_rows(found, T.axes(blocks, "gallery_key", "body", found, THIS_YEAR), "gallery_key")


def phrase_locate(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with the phrase; line_no is the page where a text has form feeds."""
    found = L.phrase_lines(table(spark, folder, "documents"), "doc_id", "text", "the gardener")
    return found.select("doc_id", F.coalesce("page", "line_no").alias("line_no"), "line")


def dehyphenate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "glossary").where("definition is not null").select("entry_id", X.dehyphenate(X.lines_of(F.col("definition"))).alias("joined"))


def ligatures(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "glossary").select("entry_id", X.ligatures(F.col("term")).alias("term"), X.ligatures(F.col("definition")).alias("definition"))


def shortened(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "glossary").select("entry_id", X.shorten(F.col("definition"), 60).alias("short"))


def shifted_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Terms set 29 code points down, as a broken font gives them, and read again."""
    low, high = "".join(map(chr, range(0x21, 0x5E))), "".join(map(chr, range(0x3E, 0x7B)))
    word = F.regexp_replace(F.concat_ws(" ", "term", "definition"), "[^a-zA-Z]", "")
    broken = F.concat(F.lit("no. "), F.translate(F.concat(F.lit("the"), F.lower(word)), high, low), F.lit("À end"))
    spaced = F.concat(F.lit("no "), F.translate(F.lower(word), high, low), F.lit("\x03"), F.translate(F.lit("end"), high, low))
    return table(spark, folder, "owlmanac_2016").select("entry_id", X.shifted_decode(broken).alias("read"), X.shifted_spaces_decode(spaced).alias("spaced"))


def readability(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.is_garbled(F.col("text")).alias("is_garbled"), X.is_readable_font(F.col("text")).alias("is_readable"))


def entry_warnings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "glossary").select("entry_id", F.explode(X.entry_warnings(F.col("term"), F.col("definition"))).alias("warning"))
    return rows


def multi_value_split(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct labels in "; "-separated values."""
    value = F.concat_ws("; ", "entry_type", "file_format", F.lit(""), "evidence")
    labels = F.filter(F.split(value, "; "), lambda x: x != "")
    return table(spark, folder, "bibliography").select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n_uses"))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """A timeline of each gallery's placements: its own years, the years of two photos, comments."""
    galleries = table(spark, folder, "galleries").groupBy("gallery_key").agg(F.min("opened_at").alias("opened"), F.max("closed_at").alias("closed"))
    opened, closed = F.year("opened").cast("string"), F.coalesce(F.year("closed").cast("string"), F.lit("now"))
    body = F.concat(
        F.lit("# made\nfrom: 2012\nOwn: ?"), opened, F.lit("-"), closed, F.lit(" Whole; "), opened, F.lit("?; Late: 2020-\n[Photos]\n* First: "), opened,
        F.lit("\nno colon here\n[Photos]: 2015-2016 A; bad span\nBoth: ?"), opened, F.lit("?"),
    )
    return galleries.where("opened is not null").select("gallery_key", body.alias("body"))


def timeline_parse(spark: SparkSession, folder: str) -> DataFrame:
    return T.segments(_blocks(spark, folder), "gallery_key", "body", THIS_YEAR)


def timeline_axis(spark: SparkSession, folder: str) -> DataFrame:
    blocks = _blocks(spark, folder)
    axis = T.axes(blocks, "gallery_key", "body", T.segments(blocks, "gallery_key", "body", THIS_YEAR), THIS_YEAR)
    return axis.select("gallery_key", "start_year", "end_year", "step", F.array_join(F.transform("ticks", lambda t: t.cast("string")), ",").alias("ticks"))


def timeline_geometry(spark: SparkSession, folder: str) -> DataFrame:
    blocks = _blocks(spark, folder)
    found = T.segments(blocks, "gallery_key", "body", THIS_YEAR)
    made = T.geometry(found, T.axes(blocks, "gallery_key", "body", found, THIS_YEAR), "gallery_key")
    return made.select("gallery_key", "line_no", "segment_no", F.round("left_percent", 6).alias("left_percent"), F.round("width_percent", 6).alias("width_percent"), "is_clipped", "is_alternate", "dates")


QUERIES = {
    f.__name__: f
    for f in (
        furniture_filter, term_heuristic, next_text_line, parse_numbered, parse_indent, parse_para, parse_inline, parse_colon, parse_plain, layout_argmax,
        cursor_locate, cursor_locate_colon, column_cut, column_cut_indent, column_cut_smart, column_starts, assign_columns, offset_histogram, offset_peaks, offset_shares, offset_shares_near, phrase_locate, dehyphenate, ligatures,
        shortened, shifted_decode, readability, entry_warnings, multi_value_split, timeline_parse, timeline_axis, timeline_geometry, timeline_tight,
    )
}

_LINES = """
with lines as (select line_id, doc, page, coalesce(page, 0) * 1000000 + coalesce(col_no, 0) * 10000 + coalesce(line_no, 0) as position, coalesce(text, '') as text from page_lines),
led as (select *, coalesce(first_value(case when trim(text) <> '' then text end ignore nulls) over (partition by doc order by position, line_id rows between 1 following and unbounded following), '') as following from lines)
"""


def _joined(lines: str) -> str:
    """A list of lines as running text, a hyphen at a line's end undone before a small letter."""
    bare = f"list_filter(list_transform({lines}, lambda x: trim(regexp_replace(x, '[\\s\\v\\x{{85}}\\p{{Z}}]+', ' ', 'g'))), lambda x: x <> '')"
    mends = "ends_with(done, '-') and regexp_matches(x, '^\\p{Ll}') and not contains(split_part(x, ' ', 1), '-')"
    return f"list_reduce({bare}, lambda done, x: case when done = '' then x when {mends} then substr(done, 1, length(done) - 1) || x else done || ' ' || x end, '')"


_ENTRIES = f""", started as (select *, sum(case when is_start then 1 else 0 end) over (partition by doc order by position, line_id) as entry_no from marked),
gathered as (select doc, entry_no, list(trim(text) order by position, line_id) as l from started where entry_no > 0 and trim(text) <> '' group by doc, entry_no)
select doc, entry_no, l[1] as term, {_joined("l[2:]")} as definition, len(l) as n_lines from gathered"""
_PARAGRAPHS = """, numbered as (select *, sum(case when trim(text) = '' then 1 else 0 end) over (partition by doc order by position, line_id) as paragraph from lines),
parts as (select doc, paragraph, min(position) as position, list(trim(text) order by position, line_id) as l, arg_min(line_id, {'p': position, 'l': line_id}) as line_id from numbered where trim(text) <> '' group by doc, paragraph)
"""


def _merged(join: str) -> str:
    return f""", started as (select *, sum(case when is_start then 1 else 0 end) over (partition by doc order by position, line_id) as entry_no from marked),
merged as (select doc, entry_no, arg_min(term, {{'p': position, 'l': line_id}}) as term, list(body order by position, line_id) as bodies, sum(len(l)) as n_lines from started where entry_no > 0 group by doc, entry_no)
select doc, entry_no, term, {join} as definition, n_lines from merged"""


_WIDE = """
with rows as (select doc, page, line_no, coalesce(max(case when col_no = 1 then rtrim(text) end), '') as a, coalesce(max(case when col_no = 2 then rtrim(text) end), '') as b, coalesce(max(case when col_no = 3 then rtrim(text) end), '') as c
  from page_lines where col_no <= 3 group by doc, page, line_no),
sized as (select *, greatest(max(length(a)) over w + 2, 40) as x, greatest(max(length(b)) over w + 2, 40) as y from rows window w as (partition by doc, page)),
wide as (select doc, page, line_no, rtrim(rpad(a, cast(x as int), ' ') || rpad(b, cast(y as int), ' ') || c) as line, x, x + y as z from sized)
"""
_CHARS = _WIDE + """, chars as (select doc, page, unnest(generate_series(1, length(line))) as i, line from wide where trim(line) <> ''),
starts as (select doc, page, i - 1 as o, case when i = 1 or (i > 2 and substr(line, i - 2, 1) = ' ') then 2 else 1 end as w from chars where substr(line, i, 1) <> ' ' and (i = 1 or substr(line, i - 1, 1) = ' ')),
hist as (select doc, page, cast(o as int) as "offset", sum(w) as n from starts group by doc, page, o)
"""
_YEARS = """
with g as (select gallery_key, year(min(opened_at)) as o, year(max(closed_at)) as c from galleries group by gallery_key having min(opened_at) is not null),
segs as (
  select gallery_key, 2 as line_no, 0 as segment_no, 0 as group_no, true as is_top_level, 'Own' as label, 'Whole' as text, false as is_marker, o as first_year, coalesce(c, 2024) as last_year, true as fades_in, false as fades_out, c is null as is_open, false as is_point from g
  union all select gallery_key, 2, 1, 0, true, 'Own', '', false, o, o, false, true, false, false from g
  union all select gallery_key, 4, 0, 1, false, 'First', '', true, o, o, false, false, false, true from g
  union all select gallery_key, 6, 0, 1, true, 'Photos', 'A', false, 2015, 2016, false, false, false, false from g
  union all select gallery_key, 7, 0, 1, false, 'Both', '', false, o, o, true, true, false, false from g
  union all select gallery_key, 2, 2, 0, true, 'Own', 'Late', false, 2020, 2024, false, false, true, false from g),
axis as (select gallery_key, 2012 as start_year, greatest(max(last_year), 2013) as end_year from segs group by gallery_key)
"""

SQL = {
    "furniture_filter": r"select line_id from page_lines where not regexp_full_match(trim(coalesce(text, '')), '(?:-? ?\d{1,3} ?-?|Page \d+( of \d+)?|\[\d+\]|Printed for .*)')",
    "term_heuristic": r"""with t as (select line_id, trim(text) as t from page_lines where text is not null),
  w as (select line_id, t, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: not regexp_matches(w, '^[\p{Lu}\p{Nd}“"''(]') and lower(w) not in ('and', 'of', 'the', 'a', 'or', 'to', 'in', 'de', 'for', 'at', 'on', '&', '/'))) as low, len(regexp_split_to_array(t, '\s+')) as n from t)
  select line_id, length(t) > 0 and length(t) <= 40 and not regexp_matches(t, '^[0-9]\.\s') and not (regexp_matches(t, '[.,;:!?"”’]$') or (ends_with(t, ')') and not contains(t, '('))) and regexp_matches(t, '^[\p{Lu}\p{Nd}“"''(]') and low <= case when n <= 3 and length(t) <= 25 then 1 else 0 end as like_term from w""",
    "next_text_line": _LINES + r"select line_id, following, length(following) - length(regexp_replace(following, '^\s+', '')) as indent from led",
    "parse_numbered": r"""with lines as (select line_id, doc, position, case when position % 3 = 0 and trim(t) <> '' then '1. ' || trim(t) else t end as text from (select line_id, doc, coalesce(page, 0) * 1000000 + coalesce(col_no, 0) * 10000 + coalesce(line_no, 0) as position, coalesce(text, '') as t from page_lines)),
led as (select *, coalesce(first_value(case when trim(text) <> '' then text end ignore nulls) over (partition by doc order by position, line_id rows between 1 following and unbounded following), '') as following from lines),
marked as (select *, trim(text) <> '' and not regexp_matches(trim(text), '^[0-9]\.\s') and starts_with(trim(following), '1.') as is_start from led)""" + _ENTRIES,
    "parse_indent": _LINES + r""", marked as (select *, trim(text) <> '' and length(following) - length(regexp_replace(following, '^\s+', '')) > length(text) - length(regexp_replace(text, '^\s+', '')) and not regexp_matches(trim(text), '^[0-9]\.\s')
  and not (regexp_matches(trim(following), '^[0-9]\.\s') and not starts_with(trim(following), '1.')) and (not regexp_matches(trim(text), '[.!?”"]$') or length(trim(text)) <= 12) and length(trim(text)) <= 45 as is_start from led)""" + _ENTRIES,
    "parse_para": _LINES + _PARAGRAPHS + r""", marked as (select *, l[1] as term, (length(l[1]) <= 45 and not regexp_matches(l[1], '[.,;]$') and not regexp_matches(l[1], '^\p{Ll}') and len(l) > 1) or position = min(position) over (partition by doc) as is_start from parts)""".replace("marked as (select *", "judged as (select *")
  + f", marked as (select *, case when is_start then {_joined('l[2:]')} else {_joined('l')} end as body from judged)" + _merged(_joined("bodies")),
    "parse_inline": _LINES + _PARAGRAPHS + f", whole as (select *, {_joined('l')} as w from parts)" + r""", marked as (select *, regexp_extract(w, '^(\S+)', 1) as term, not regexp_matches(l[1], '^\p{Ll}') or position = min(position) over (partition by doc) as is_start,
  case when not regexp_matches(l[1], '^\p{Ll}') or position = min(position) over (partition by doc) then regexp_extract(w, '(?s)^\S+\s+(.*)$', 1) else w end as body from whole)""" + _merged(_joined("bodies")),
    "parse_colon": _LINES + _PARAGRAPHS + f", whole as (select *, {_joined('l')} as w from parts)" + r""", marked as (select *, regexp_matches(w, '(?s)^([^:]{1,60}):\s*(.*)$') as is_start, trim(regexp_extract(w, '(?s)^([^:]{1,60}):\s*(.*)$', 1)) as term,
  case when regexp_matches(w, '(?s)^([^:]{1,60}):\s*(.*)$') then trim(regexp_extract(w, '(?s)^([^:]{1,60}):\s*(.*)$', 2)) else w end as body from whole)""" + _merged("array_to_string(list_filter(bodies, lambda x: x <> ''), ' ')"),
    "dehyphenate": f"select entry_id, {_joined('l')} as joined from (select entry_id, regexp_split_to_array(definition, '\\r\\n|[\\n\\r\\x{{0B}}\\x{{0C}}\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]') as l from glossary where definition is not null)",
    "column_cut": _WIDE + "select doc, page, line_no, trim(substr(line, 1, x)) as first, trim(substr(line, x + 1, z - x)) as second, trim(substr(line, z + 1)) as third from wide",
    "column_cut_indent": _WIDE + r""", c as (select doc, page, line_no, rtrim(substr(line, 1, x)) as a, rtrim(substr(line, x + 1, z - x)) as b from wide),
  i as (select *, min(case when a <> '' then length(a) - length(ltrim(a)) end) over (partition by doc, page) as ia, min(case when b <> '' then length(b) - length(ltrim(b)) end) over (partition by doc, page) as ib from c)
  select doc, page, line_no, substr(a, coalesce(ia, 0) + 1) as first, substr(b, coalesce(ib, 0) + 1) as second from i""",
    "assign_columns": _WIDE + r""", places as (select *, unnest(generate_series(1, length(line))) as i from wide where line <> ''),
  segs as (select doc, page, line_no, cast(i - 1 as int) as start, regexp_extract(substr(line, i), '^\S+(?: \S+)*') as segment, x, z from places
    where substr(line, i, 1) <> ' ' and (i = 1 or (substr(line, i - 1, 1) = ' ' and (i = 2 or substr(line, i - 2, 1) = ' '))))
  select doc, page, line_no, start, segment, case when z <= start + 4 then 2 when x <= start + 4 then 1 else 0 end as column_no from segs""",
    "column_starts": _CHARS + """, widths as (select doc, page, max(length(line)) as w from wide where line <> '' group by doc, page),
  offs as (select doc, page, unnest(generate_series(0, cast(w - 1 as bigint))) as o from widths),
  shares as (select doc, page, o, case when n < 5 then 1.0 else across / n end as cut, case when n < 5 then 0.0 else st / n end as st, n >= 5 and soon / n >= 0.5 and o >= 25 as likely from (
    select f.doc, f.page, f.o, count(*) as n, count(*) filter (not contains(substr(v.line, greatest(f.o - 1, 1), least(3, f.o + 1)), ' ')) as across,
      count(*) filter (f.o > 0 and substr(v.line, f.o + 1, 1) <> ' ' and substr(v.line, f.o, 1) = ' ') as st,
      count(*) filter (regexp_matches(substr(v.line, f.o, 4), '^ [^ ]|^. [^ ]|^.. [^ ]')) as soon
    from offs f join wide v on v.doc is not distinct from f.doc and v.page is not distinct from f.page and length(v.line) > f.o group by f.doc, f.page, f.o)),
  scored as (select doc, page, "offset" as o, n + coalesce(case when lead("offset") over w = "offset" + 1 then lead(n) over w end, 0) as score from hist window w as (partition by doc, page order by "offset")),
  ranked as (select doc, page, list({'s': score, 'o': o} order by score desc, o desc) as r from scored group by doc, page),
  peaked as (select doc, page, list_reduce(r, lambda done, x: case when len(done) < 6 and len(list_filter(done, lambda d: abs(d.o - x.o) < 10)) = 0 then list_append(done, x) else done end, cast([] as struct(s hugeint, o int)[])) as chosen from ranked),
  tried as (select doc, page, unnest(list_sort(list_filter(list_transform(chosen, lambda x: x.o), lambda o: o > 5))[:5]) as c from peaked union select doc, page, cast(o as int) from shares where likely),
  near as (select t.doc, t.page, t.c, cast(greatest(t.c - 6, 1) + k as int) as o from tried t, range(13) as g(k) where greatest(t.c - 6, 1) + k <= t.c + 6),
  nudged as (select distinct n.doc, n.page, arg_min({'o': n.o, 'cut': coalesce(s.cut, 1.0)}, {'cut': coalesce(s.cut, 1.0), 'st': -coalesce(s.st, 0.0), 'd': abs(n.o - n.c), 'o': n.o}) as b
    from near n left join shares s on s.doc is not distinct from n.doc and s.page is not distinct from n.page and s.o = n.o group by n.doc, n.page, n.c),
  listed as (select w.doc, w.page, list_reduce(coalesce(list(b.o order by b.o) filter (b.cut <= 0.1), []), lambda done, o: case when o - coalesce(done[-1], 0) >= 25 then list_append(done, o) else done end, cast([] as int[])) as kept
    from widths w left join nudged n on n.doc is not distinct from w.doc and n.page is not distinct from w.page group by w.doc, w.page)
  select doc, page, array_to_string(kept[:2], ',') as starts from listed""",
    "offset_histogram": _CHARS + """select doc, page, "offset", n, n + coalesce(case when lead("offset") over w = "offset" + 1 then lead(n) over w end, 0) as score from hist window w as (partition by doc, page order by "offset")""",
    "offset_peaks": _CHARS + """, scored as (select doc, page, "offset" as o, n + coalesce(case when lead("offset") over w = "offset" + 1 then lead(n) over w end, 0) as score from hist window w as (partition by doc, page order by "offset")),
  ranked as (select doc, page, list({'s': score, 'o': o} order by score desc, o desc) as r from scored group by doc, page),
  peaked as (select doc, page, list_reduce(r, lambda done, x: case when len(done) < 3 and len(list_filter(done, lambda d: abs(d.o - x.o) < 10)) = 0 then list_append(done, x) else done end, cast([] as struct(s hugeint, o int)[])) as chosen from ranked)
  select doc, page, array_to_string(list_sort(list_filter(list_transform(chosen, lambda x: x.o), lambda o: o > 5))[:2], ',') as offsets from peaked""",
    "offset_shares": _WIDE + """, e as (select doc, page, line, unnest([35, 40, 60, 80]) as "offset" from wide)
  select doc, page, "offset", case when count(*) < 5 then 1.0 else count(*) filter (not contains(substr(line, greatest("offset" - 1, 1), 3), ' ')) / count(*) end as cut_share,
    case when count(*) < 5 then 0.0 else count(*) filter (substr(line, "offset" + 1, 1) <> ' ' and substr(line, "offset", 1) = ' ') / count(*) end as start_share from e where length(line) > "offset" group by doc, page, "offset" """,
    "offset_shares_near": _WIDE + """, e as (select doc, page, line, unnest([35, 40, 60, 80]) as "offset" from wide)
  select doc, page, "offset", case when count(*) < 5 then 1.0 else count(*) filter (not contains(substr(line, greatest("offset" - 1, 1), 3), ' ')) / count(*) end as cut_share,
    case when count(*) < 5 then 0.0 else count(*) filter (regexp_matches(substr(line, "offset", 4), '^ [^ ]|^. [^ ]|^.. [^ ]')) / count(*) end as start_share from e where length(line) > "offset" group by doc, page, "offset" """,
    "phrase_locate": r"""select doc_id, cast(i as int) as line_no, substr(trim(l[i]), 1, 160) as line from (select doc_id, l, unnest(generate_series(1, len(l))) as i from (select doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]') as l from documents where text is not null)) where contains(lower(l[i]), 'the gardener')""",
    "ligatures": """select entry_id, replace(replace(replace(replace(replace(replace(term, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬀ', 'ff'), chr(172), ''), chr(65279), '') as term,
  replace(replace(replace(replace(replace(replace(definition, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬀ', 'ff'), chr(172), ''), chr(65279), '') as definition from glossary""",
    "shortened": "select entry_id, case when length(definition) > 60 then substr(definition, 1, 59) || '…' else definition end as short from glossary",
    "shifted_decode": "with w as (select entry_id, lower(regexp_replace(concat_ws(' ', term, definition), '[^a-zA-Z]', '', 'g')) as w from owlmanac_2016) select entry_id, 'no. ⟨the' || w || 'fi⟩ end' as read, 'no ' || w || ' end' as spaced from w",
    "readability": r"""with c as (select doc_id, text, length(regexp_replace(text, '[\s\v\x{85}\p{Z}]', '', 'g')) as full_n, length(regexp_replace(text, '[^\p{L}]', '', 'g')) as l, length(regexp_replace(text, '[^\p{Ll}]', '', 'g')) as s, length(regexp_replace(text, '[^\p{Ll} ]', '', 'g')) as g from documents)
  select doc_id, coalesce(l / nullif(full_n, 0) < 0.6 or s / nullif(l, 0) < 0.6, true) or contains(text, chr(3)) as is_garbled, length(text) >= 20 and g * 2 >= length(text) as is_readable from c""",
    "entry_warnings": r"""with w as (select entry_id, unnest([case when coalesce(definition, '') = '' then 'no definition' end, case when length(term) > 40 then 'long term' end, case when regexp_matches(term, '^\p{Ll}') then 'term starts in lower case' end,
  case when regexp_matches(term, '[.,;:]$') and length(term) > 3 then 'term ends in punctuation' end, case when length(definition) > 600 then 'long definition' end, case when regexp_matches(definition, '^\p{Ll}') then 'definition starts in lower case' end]) as warning from glossary)
  select entry_id, warning from w where warning is not null""",
    "multi_value_split": "select label, count(*) as n_uses from (select unnest(list_filter(string_split(concat_ws('; ', entry_type, file_format, '', evidence), '; '), lambda x: x <> '')) as label from bibliography) group by label",
    "timeline_parse": _YEARS + "select *, last_year < first_year as is_reversed from segs",
    "timeline_axis": _YEARS + "select gallery_key, start_year, end_year, 5 as step, array_to_string(generate_series(2015, end_year, 5), ',') as ticks from axis",
    "timeline_tight": _YEARS + "select gallery_key, line_no, count(*) > 1 and bool_or(last_year - greatest(first_year, start_year) + 1 < 4 and not is_point) as is_tight from segs join axis using (gallery_key) group by gallery_key, line_no",
    "timeline_geometry": _YEARS + """select gallery_key, line_no, segment_no, round(case when is_marker then (first_year - start_year) * 100.0 / (end_year + 1 - start_year) + 50.0 / (end_year + 1 - start_year) else (greatest(first_year, start_year) - start_year) * 100.0 / (end_year + 1 - start_year) end, 6) as left_percent,
  round(case when not is_marker then (least(last_year, end_year) + 1 - start_year) * 100.0 / (end_year + 1 - start_year) - (greatest(first_year, start_year) - start_year) * 100.0 / (end_year + 1 - start_year) end, 6) as width_percent,
  not is_marker and start_year > first_year as is_clipped, segment_no % 2 = 1 as is_alternate, case when is_marker or (first_year = last_year and not is_open) then cast(first_year as varchar) else first_year || '–' || case when is_open then 'now' else cast(last_year as varchar) end end as dates from segs join axis using (gallery_key)""",
}
