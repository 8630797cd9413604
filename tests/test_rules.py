"""Rules whose edge cases the driver's tables don't hold."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import text as X
from quirework.operators import catalog as K
from quirework.operators import citation_rules as R
from quirework.operators import citations as C
from quirework.operators import layouts as L
from quirework.operators import manifests as M
from quirework.operators import series as S
from quirework.operators import shapes
from quirework.plans.rules import CORPUS, RULES
from quirework.sources.files import quoted_manifest, setting
from quirework.sources.sinks import photo_grid, replaced_marker


def named(spark, rows):
    items = spark.createDataFrame([(k, f, t) for k, (f, t) in enumerate(rows)], "at long, folder string, t string")
    return [r.name for r in M.slugged(items, "folder", "t", "at").orderBy("at").collect()]


@pytest.mark.parametrize(
    ("texts", "names"),
    [
        (["a", "a-2", "a"], ["a", "a-2", "a-3"]), (["a", "a", "a-2"], ["a", "a-2", "a-2-2"]), (["a-2", "a", "a", "a"], ["a-2", "a", "a-3", "a-4"]),
        (["a", "a", "a 3", "a", "a-3"], ["a", "a-2", "a-3", "a-4", "a-3-2"]), ([None, "", "img", "!"], ["img", "img-2", "img-3", "img-4"]), (["a", "a-02", "a"], ["a", "a-02", "a-2"]), ([], []),
    ],
)
def test_names_count_on_to_the_next_unused(spark, texts, names):
    assert named(spark, [("f", t) for t in texts]) == names


def test_names_as_one_by_one(spark):
    r = random.Random(4)
    rows = [(r.choice("fg"), r.choice(["a", "a", "a 2", "a-3", "a-2-2", "b", "b-2", "c"])) for _ in range(300)] + [("h", "hot")] * 5000
    used, expected = {}, []
    for folder, text in rows:
        slug = text.replace(" ", "-")
        name, n, taken = slug, 2, used.setdefault(folder, set())
        while name in taken:
            name, n = f"{slug}-{n}", n + 1
        taken.add(name)
        expected.append(name)
    assert named(spark, rows) == expected


def test_waits(spark):
    rows = spark.createDataFrame([(0.0, 1), (None, 2), (5.0, 3), (9999.0, 1), (None, 30)], "asked double, n int")
    assert [r[0] for r in rows.select(X.backoff(F.col("asked"), F.col("n"))).collect()] == [60.0, 120.0, 5.0, 900.0, 900.0]


@pytest.mark.parametrize("width", [2, 65_536])
def test_a_run_that_stopped_stays_stopped(spark, width):
    log = [(k, "s", o) for k, o in enumerate(["throttled", "fetched", *["throttled"] * 5, "fetched", "throttled"])] + [(50, "other", "throttled"), (51, None, "failed")]
    rows = M.fetch_state(spark.createDataFrame(log, "seq long, stream string, outcome string"), "stream", "seq", "outcome", width=width).orderBy("seq").collect()
    assert [r.failures for r in rows] == [1, 0, 1, 2, 3, 4, 5, 0, 1, 1, 0]
    assert [r.stopped for r in rows] == [False] * 6 + [True] * 3 + [False] * 2


def lines(spark, texts, doc="d"):
    return spark.createDataFrame([(k, doc, 1, k, t) for k, t in enumerate(texts)], "line_id long, doc string, page int, position long, text string")


def test_colon_paragraphs_continue_after_a_space(spark):
    read = L.read_colon(lines(spark, ["Lost: before", "", "Bench: a well-", "worn seat and a well-", "", "worn lamp", "", "Gong:", "", "- end -"]))
    assert [(r.term, r.definition) for r in read.orderBy("entry_no").collect()] == [("Lost", "before"), ("Bench", "a wellworn seat and a well- worn lamp"), ("Gong", "- end -")]


def test_of_equally_long_parts_the_first_declared_is_named(spark):
    part = lambda place: spark.range(1).select(C.named_part(F.create_map(F.lit("vol b"), F.lit("1"), F.lit("vol a"), F.lit("2"), F.lit("vol ab"), F.lit("3")), F.lit(place))).collect()[0][0]
    assert part("Vol A and vol b") == "vol b" and part("vol ab, vol a") == "vol ab" and part("vol abc") is None


def test_a_citation_does_not_close_beyond_a_fence(spark):
    page = "see [@open p.1\n```\n[@hidden]\n```\nend] and [@shown p.2]\n```\nnever closed [@kept]"
    found = C.extract(spark.createDataFrame([(1, page), (2, None), (3, "")], "i int, t string"), "i", "t").collect()
    assert [(r.i, r.pos, r.key, r.locator) for r in found] == [(1, 0, "shown", " p.2"), (1, 1, "kept", "")]


def test_columns_that_drift(spark):
    rows = ["left words here      right words", "left words that run on right words", "no break atallinthislongpiece of text", "", None, "   right only"]
    made = spark.createDataFrame([(t,) for t in rows], "t string").select(L.cut_drifting(F.col("t"), F.array(F.lit(21)), 8)).collect()
    assert made[0][0] == ["left words here", "right words"] and made[1][0] == ["left words that run on", "right words"]
    assert made[2][0] == ["no break atallinthislongpiece of text", ""] and made[3][0] == ["", ""] and made[4][0] is None


def test_column_starts(spark):
    r = random.Random(2)
    words = ["steward", "bench", "a", "of", "lamps", "gong", "cider"]
    column = lambda width: " ".join(r.choice(words) for _ in range(40))[: width - 2].ljust(width)
    rows = [(1, column(40) + " " * r.randrange(2) + column(40) + column(30)) for _ in range(30)] + [(2, column(60)) for _ in range(30)] + [(3, column(40) + column(40)) for _ in range(3)] + [(4, ""), (5, None)]
    found = {x.page: x.starts for x in L.column_starts(spark.createDataFrame(rows, "page int, t string"), ["page"], "t").collect()}
    assert 38 <= found[1][0] <= 41 and 78 <= found[1][1] <= 82 and found[2] == [] and found[3] == []


def test_terms_that_open_their_line(spark):
    there = lines(spark, ["Gong: a bell", "Bench: see Gong", "x", "Gong: again", "Lamp"])
    entries = spark.createDataFrame([("d", 1, "Gong"), ("d", 2, "Bench"), ("d", 3, "Gong"), ("d", 4, "Bench"), ("d", 5, "Lamp")], "doc string, entry_no long, term string")
    sure = lambda **how: [r.is_certain for r in L.locate(entries, there, **how).orderBy("entry_no").collect()]
    assert sure(starts_line=True) == [True, True, True, False, True] and sure() == [False, False, False, False, True]


CATALOG = "source_key string, title string, date_raw string, file_format string, url string, parts map<string,string>, held_by string"


@pytest.mark.parametrize(
    ("key", "locator", "url", "label", "found"),
    [
        ("cap", " 20010203040506 http://www.a.example/x note  of it", "https://captures.example/web/20010203040506/http://www.a.example/x", "a.example/x, archived 2001-02-03, note  of it (Capture Machine)", True),
        ("cap", " 20010203040506", None, "[@cap 20010203040506]", False), ("cap", "", None, "[@cap]", False), ("cap", None, None, "[@cap]", False),
        ("paper", " paper-1 p.14, top", "https://papers.example/id/paper-1/m1/14/", "Larkmoor Paper, 5 Oct 1984, p.14, top (Portal of Papers)", True),
        ("paper", " other pp.14-15", "https://papers.example/id/other/", "Larkmoor Paper, pp.14-15 (Portal of Papers)", True), ("paper", "  ", None, "[@paper  ]", False),
        ("blog", " 2021-12-10 a-post comment", "https://blog.example/2021/12/10/a-post/", "Larkmoor Corner, 2021-12-10, comment", True), ("blog", "", "https://blog.example/all", "The Blog", True),
        ("archive", " box 4", "https://archive.example/", "Larkmoor Archive, box 4", True), ("scans", " /item/7 Annual, p.2", "https://scans.example/item/7", "Annual, p.2 (Scan Collections)", True),
        ("scans", " http://x.example/1", "http://x.example/1", "Library Scan Collections item (Scan Collections)", True), ("scans", "", None, "[@scans]", False), ("none", " p.1", None, "[@none p.1] (unknown source key)", False),
    ],
)
def test_citations_by_rule(spark, key, locator, url, label, found):
    catalog = spark.createDataFrame([("blog", "The Blog", None, None, "https://blog.example/all", None, None)], CATALOG)
    issues = spark.createDataFrame([("paper-1", "1984-10-05")], "paper string, issued string")
    cited = spark.createDataFrame([(1, key, locator, "clash")], "i int, cite_key string, locator string, paper string")
    made = R.resolve_all(cited, catalog, RULES, issues).collect()
    assert [(r.url, r.label, r.found, r.paper) for r in made] == [(url, label, found, "clash")]


def test_what_a_check_of_links_asks_for(spark):
    cited = [(1, "cap", "20010203040506 http://a.example/x y"), (2, "cap", "2001"), (3, "paper", "id1 pp.27"), (4, "blog", "2021-12-10 Any_Word"), (5, "blog", "2021-12 x"), (6, "archive", "x y"), (7, None, None)]
    made = {r.i: (r.target, r.stamp, r.original) for r in R.checked_targets(spark.createDataFrame(cited, "i int, cite_key string, locator string"), RULES).collect()}
    assert made == {1: (None, "20010203040506", "http://a.example/x"), 3: ("https://papers.example/id/id1/m1/27/", None, None), 4: ("https://blog.example/2021/12/10/Any_Word/", None, None)}


@pytest.mark.parametrize(
    ("path", "citation"),
    [
        ("D:\\x\\corpus\\s\\mirror\\h.example\\a\\20010203040506__f.html", "[@cap 20010203040506 http://h.example/a/f.html]"), ("s/mirror/h.example/20010203040506__f.html", "[@cap 20010203040506 http://h.example/f.html]"),
        ("old.larkmoor.example/text/a__b.html__20010203040506.md", "[@cap 20010203040506 http://old.larkmoor.example/pages/a/b.html]"), ("odd.example/text/a__b.html__20010203040506.md", "(no rule for odd.example/text/a__b.html__20010203040506.md)"),
        ("books.example/yearbooks/1987-yearbook-2.pdf", "[@yearbook-1987 p.N]"), ("corner.example/posts/2019-10-05_x-y.md", "[@blog 2019-10-05 x-y]  → https://blog.example/2019/10/05/x-y/"), ("", "(no rule for )"), (None, None),
    ],
)
def test_paths(spark, path, citation):
    assert spark.createDataFrame([(path,)], "p string").select(R.path_citation(F.col("p"), CORPUS)).collect()[0][0] == citation


def test_missing_columns_editions_and_quotes(spark, tmp_path):
    with pytest.raises(ValueError, match="keep"):
        K.kept_rows(spark.createDataFrame([(1,)], "title int"), "keep", "title")
    lined = spark.createDataFrame([("a-2001", "k", "d")], "edition string, key string, definition string")
    with pytest.raises(ValueError, match="a-2001"):
        S.pair_report(lined, "a-2001", "b-2002")
    (tmp_path / "m.tsv").write_text('path\tcaption\nx\t"a ""b""\tc\nd"\ny\t\n')
    assert [tuple(r) for r in quoted_manifest(spark, str(tmp_path / "m.tsv"), ["path", "caption"]).collect()] == [("x", 'a "b"\tc\nd'), ("y", "")]
    with pytest.raises(ValueError, match="width"):
        quoted_manifest(spark, str(tmp_path / "m.tsv"), ["width"])


def test_pairs_need_their_prefix(spark):
    rows = [("a/p", 1, "f\thttps://x/1"), ("a/p", 2, "g\thttps://x/2"), ("b", 1, "f\thttp://x/1"), ("a", 1, "t\td"), ("a", 2, "1\t2")]
    frame = spark.createDataFrame(rows, "f string, o int, l string")
    assert {r.f: r.layout for r in M.sniff(frame, "f", "o", "l", ["t", "d"], "https://").collect()} == {"a/p": "pairs", "b": "skipped", "a": "records"}
    union = M.sniffed_union(frame, "f", "o", "l", ["t", "d"], "https://", only="a").collect()
    assert sorted((r.f, r.t) for r in union) == [("a", "1"), ("a/p", "f"), ("a/p", "g")]


def test_places_of_glyphs(spark):
    glyphs = spark.createDataFrame([("f", k, "abcdefghij"[k]) for k in range(10)] + [("g", 0, "a"), ("g", 1, "b"), ("h", 0, "a"), ("h", 1, "x"), ("h", 2, "c"), ("h", 3, " ")], "font string, glyph int, meant string")
    standard = spark.createDataFrame([(k, "abcdefghiX"[k]) for k in range(10)], "glyph int, meant string")
    assert {r.font: (r.n_checked, r.n_in_place, r.follows) for r in shapes.in_place(glyphs, standard).collect()} == {"f": (10, 9, True), "g": (2, 2, False), "h": (3, 2, False)}


@pytest.mark.parametrize("group_rows", [10**6, 15])
def test_nearest_captures_of_hot_keys(spark, group_rows):
    r = random.Random(6)
    stamp = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=n)
    cited = [(k, r.choice(["hot", "hot", "b", "never", None]), stamp(r.randrange(500)) if k % 17 else None) for k in range(200)]
    taken = [(r.choice(["hot", "b"]), stamp(r.randrange(500))) for _ in range(60)] * 2 + [(None, stamp(1)), ("b", None)]
    found = C.nearest_capture(spark.createDataFrame(cited, "i long, k string, at timestamp"), spark.createDataFrame(taken, "k string, at timestamp"), "k", "at", "at", "i", group_rows)
    expected = {}
    for k, key, at in cited:
        times = [t for other, t in taken if other == key and t is not None]
        if key is not None and at is not None and times:
            expected[k] = min(times, key=lambda t: (abs(t - at), t))
    assert {x.row_id: x.captured_at for x in found.collect()} == expected


def test_forms_of_names(spark):
    one = lambda c: spark.range(1).select(c).collect()[0][0]
    assert one(X.squash_name(F.lit("Noto Sans-3 Ü"))) == "notosans3" and one(X.heading_slug(F.lit(" Café & The  Old—Hall_1 "))) == "cafe-the-oldhall_1"
    assert one(X.on_one_line(F.lit("\n a\nb \n"))) == "a b" and one(X.expand_ligature(F.lit("ﬃ"))) == "ffi" and one(X.expand_ligature(F.lit("ﬁx"))) == "ﬁx"
    assert one(X.heading_slug(F.lit(None).cast("string"))) is None and one(X.format_citation(F.lit("k"), F.lit("  "))) == "[@k]"


def test_copies_grids_markers_and_settings(spark, monkeypatch):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c")], "i int, s string")
    assert sorted(r.i for r in M.new_copies(items, spark.createDataFrame([("b",), (None,)], "s string"), "s", ["i"]).collect()) == [1, 5]
    groups = spark.createDataFrame([("g",), ("h",), ("g",), (None,)], "k string")
    photos = spark.createDataFrame([("g", 7, "p/x.jpg", "p/t/x.jpg", "a]b"), ("g", 3, "p/y.jpg", "p/t/y.jpg", None), ("z", 1, "q", "q", ""), (None, 2, "q", "q", "")], "k string, o int, photo string, thumb string, c string")
    placed = M.grouped_items(groups, photos, "k", "o")
    assert sorted(((r.k, r.place, r.o) for r in placed.collect()), key=str) == [("g", 1, 3), ("g", 2, 7), ("h", None, None)]
    grid = photo_grid(placed.withColumn("page", F.lit("life/g.md")), "page", "k", "place", "photo", "thumb", "c").orderBy("place").collect()
    assert [r.value for r in grid] == ["[![](../p/t/y.jpg)](../p/y.jpg)", "[![a\\]b](../p/t/x.jpg)](../p/x.jpg)"]
    page = spark.createDataFrame([("<!-- X --> a <!-- X -->",), ("none",)], "t string").select(replaced_marker(F.col("t"), "<!-- X -->", F.lit("$1"))).collect()
    assert [r[0] for r in page] == ["$1 a $1", "none"]
    monkeypatch.delenv("QW_FOLDER", raising=False)
    assert setting(None, "QW_FOLDER", {"f": "copy"}, "f", "/base") == "/base/copy" and setting(None, "QW_FOLDER", {"f": "/copy"}, "f", "/base") == "/copy"
    assert setting("x", "QW_FOLDER", {"f": "copy"}, "f", "/base") == "x" and setting(None, "QW_FOLDER", {}, "f", "/base") is None
