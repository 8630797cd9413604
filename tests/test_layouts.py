from pyspark.sql import functions as F

from quirework.operators import layouts as L
from quirework.operators import timelines as T


def lines(spark, text, doc="d"):
    rows = [(i, doc, 1 + i // 3, 1, i, line) for i, line in enumerate(text.split("\n"))]
    return L.positions(spark.createDataFrame(rows, "line_id long, doc string, page int, col_no int, line_no int, text string"))


def entries(spark, layout, text):
    return [(r.term, r.definition) for r in L.READERS[layout](lines(spark, text)).orderBy("entry_no").collect()]


def test_numbered(spark):
    assert entries(spark, "numbered", "lost\nBench\n\n1. A seat.\n2. An-\nother.\nGong\n1. Loud") == [("Bench", "1. A seat. 2. Another."), ("Gong", "1. Loud")]


def test_plain(spark):
    text = "lost line.\nBench Day\nA day on a bench.\nStill Short\n\nGong Hall\nBig Drum\nA hall."
    assert entries(spark, "plain", text) == [("Bench Day", "A day on a bench."), ("Still Short", "Gong Hall Big Drum A hall.")]


def test_indent(spark):
    assert entries(spark, "indent", "Bench\n  A seat of\n  oak.\nGong\n  Loud.") == [("Bench", "A seat of oak."), ("Gong", "Loud.")]


def test_para_inline_and_colon(spark):
    text = "Bench\nA seat.\n\nmore of it,\nindeed.\n\nGong\nLoud."
    assert entries(spark, "para", text) == [("Bench", "A seat. more of it, indeed."), ("Gong", "Loud.")]
    assert entries(spark, "inline", "Bench is a seat.\n\nof oak.\n\nGong") == [("Bench", "is a seat. of oak."), ("Gong", "")]
    assert entries(spark, "colon", "lost\n\nBench: a\nseat.\n\nof oak.\n\nGong: loud") == [("Bench", "a seat. of oak."), ("Gong", "loud")]


def test_no_lines_and_blank_lines(spark):
    for layout in L.READERS:
        assert entries(spark, layout, "\n\n") == []
        assert L.READERS[layout](lines(spark, "x").where("false")).count() == 0


def test_locating_goes_forward_only(spark):
    page_lines = lines(spark, "Gong\nBench\na\nBench\nGong\nb")
    wanted = spark.createDataFrame([("d", 1, "Bench"), ("d", 2, "Bench"), ("d", 3, "Drum"), ("d", 4, "Gong")], "doc string, entry_no long, term string")
    assert [(r.page, r.is_certain) for r in L.locate(wanted, page_lines).orderBy("entry_no").collect()] == [(1, True), (2, True), (2, False), (2, True)]


def test_columns(spark):
    frame = spark.createDataFrame([("  ab   cd ef    gh",), ("",), (None,)], "t string")
    rows = frame.select(L.cut(F.col("t"), [5, 12]).alias("c"), L.segments(F.col("t")).alias("s")).collect()
    assert rows[0].c == ["ab", "cd ef", "gh"] and rows[1].c == ["", "", ""]
    assert [(s.start, s.text) for s in rows[0].s] == [(2, "ab"), (7, "cd ef"), (16, "gh")]
    placed = spark.range(1).select(*(L.column_of(F.lit(n), [0, 10, 20]).alias(str(n)) for n in (0, 5, 6, 16, 30))).collect()[0]
    assert list(placed) == [0, 0, 1, 2, 2]


def test_peaks_are_apart(spark):
    rows = [(line,) for line in ["aaa bbb   ccc dd", "aa  bb    cc", "a   b     c d"] * 3]
    starts = L.word_starts(spark.createDataFrame(rows, "t string").withColumn("g", F.lit(1)), ["g"], "t")
    assert L.peaks(starts, ["g"], 3, 5).collect()[0].offsets == [10]


def test_offsets_of_blank_pages_and_null_keys(spark):
    big = 2**60 + 1
    rows = [("d", 1, ""), ("d", 1, None), ("d", 2, " ab c"), ("d", 2, "abc"), ("d", None, "a"), (None, big, "ab"), (None, big, " ")]
    found = L.offset_counts(spark.createDataFrame(rows, "doc string, page long, t string").coalesce(1), ["doc", "page"], "t")
    assert found.schema["doc"].dataType.simpleString() == "string" and found.schema["page"].dataType.simpleString() == "bigint"
    assert sorted(((r.doc, r.page, r.offset, r.n) for r in found.collect()), key=repr) == sorted(
        [("d", 2, 0, 2), ("d", 2, 1, 2), ("d", 2, 2, 2), ("d", 2, 3, 1), ("d", 2, 4, 1), ("d", None, 0, 1), (None, big, 0, 1), (None, big, 1, 1)], key=repr
    )


def test_timeline_spans(spark):
    spans = ["1987", "?1987-1992", "2010-2011?", "?2017?", "2012-", "2012-now", "1993-1980", "x-2000"]
    found = [r[0] for r in spark.createDataFrame([(s,) for s in spans], "s string").select(T.span(F.col("s"), 2024)).collect()]
    assert [(s.first_year, s.last_year, s.is_open, s.is_point, s.is_reversed) for s in found] == [
        (1987, 1987, False, True, False), (1987, 1992, False, False, False), (2010, 2011, False, False, False), (2017, 2017, False, False, False),
        (2012, 2024, True, False, False), (2012, 2024, True, False, False), (1993, 1980, False, False, True), (None, 2000, False, False, None),
    ]


def test_timeline_block(spark):
    body = "from: 1985\nto:\n# no\nTop: 1980-1990\n[Group]\n* Mark: 2005\nJob: ?1993-2006 Executive; 2007-2015 Internal, 2016- Last\nRole: Apprentice: 2001-2002\nno colon"
    blocks = spark.createDataFrame([("b", body), ("empty", ""), ("none", None)], "block string, body string")
    found = T.segments(blocks, "block", "body", 2024)
    rows = [(r.label, r.text, r.first_year, r.is_marker, r.is_top_level) for r in found.orderBy("line_no", "segment_no").collect()]
    assert rows == [
        ("Top", "", 1980, False, True), ("Mark", "", 2005, True, False), ("Job", "Executive", 1993, False, False),
        ("Job", "Internal", 2007, False, False), ("Job", "Last", 2016, False, False), ("Role", "Apprentice", 2001, False, False),
    ]
    axis = T.axes(blocks, "block", "body", found, 2024)
    assert axis.collect()[0][1:4] == (1985, 2024, 5)
    drawn = T.geometry(found, axis, "block").orderBy("line_no", "segment_no").collect()
    assert drawn[0].is_clipped and drawn[0].left_percent == 0 and drawn[4].dates == "2016–now"
    assert all(0 <= r.left_percent <= 100 for r in drawn)


def test_phrase_in_shifted_lines_and_by_page(spark):
    rows = [(1, "no\r\n The Gardener \nWKHJDUGHQHU"), (2, "a gardener\nx\fy\n see WKHJDUGHQHU\f\fgardener"), (3, "gardener\f"), (4, None), (5, "GARDENIA")]
    found = L.phrase_lines(spark.createDataFrame(rows, "row long, body string"), "row", "body", "gardener")
    assert sorted((r.row, r.page or 0, r.line_no, r.line) for r in found.collect()) == [
        (1, 0, 2, "The Gardener"), (1, 0, 3, "WKHJDUGHQHU"), (2, 1, 1, "a gardener"), (2, 2, 2, "see ⟨thegardener⟩"), (2, 4, 1, "gardener"), (3, 1, 1, "gardener"),
    ]
