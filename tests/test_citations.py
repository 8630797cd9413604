import datetime
import random

from pyspark.sql import functions as F

from quirework.operators import catalog as K
from quirework.operators import citations as C

ENTRY = "source_key string, title string, date_raw string, file_format string, url string, parts map<string,string>, held_by string"


def catalog(spark):
    rows = [
        ("book", "The Book", "1990", None, "https://x/book.PDF", {"part 1": "https://x/1", "part 10": "https://x/10", "Part": "https://x/0"}, None),
        ("page", "The Page", None, "html", "https://x/p", None, None),
        ("box", None, None, None, None, None, "the attic"),
    ]
    return spark.createDataFrame(rows, ENTRY)


def test_resolving(spark):
    cited = [(1, "book", " p.7", "t"), (2, "book", "see PART 10, p. 3", "t"), (3, "book", "part 100", "t"), (4, "page", "p.7", "t"), (5, "box", None, "t"), (6, "gone", "p.1", "t"), (7, None, None, "t"), (8, "book", "pp.2-3", "t")]
    found = {r.id: r for r in C.resolve(spark.createDataFrame(cited, "id int, cite_key string, locator string, title string"), catalog(spark)).collect()}
    assert found[1].url == "https://x/book.PDF#page=7" and found[1].label == "The Book, p.7" and found[1].hover_title == "The Book (1990)"
    assert found[2].url == "https://x/10" and found[4].url == "https://x/p"
    assert found[3].url == "https://x/0" and found[8].url == "https://x/book.PDF"
    assert found[5].label == "box (held by the attic)" and found[5].url is None and found[5].found
    assert found[6].label == "[@gone p.1] (unknown source key)" and not found[6].found and not found[7].found
    assert len(found) == 8 and found[1].title == "t"


def test_extracting(spark):
    texts = [(1, "a [@k1 p.2] b [@k-2\nlong locator] [@ bad] [@k1]\n```\n[@hidden]\n```\n[@last]"), (2, None), (3, "")]
    found = C.extract(spark.createDataFrame(texts, "page int, t string"), "page", "t").collect()
    assert [(r.pos, r.key, r.locator) for r in found] == [(0, "k1", " p.2"), (1, "k-2", "\nlong locator"), (2, "k1", ""), (3, "last", "")]


def test_numbering_is_dense_and_counts_all_uses(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["hot", "hot", "b"]), i * 700, r.choice("xyz"), r.choice(["p.1", " p.1", "p. 1", None])) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, page string, pos int, k string, loc string")
    refs = C.references(frame, "page", "pos", "k", "loc").collect()
    for page in ("hot", "b"):
        own = sorted((x for x in refs if x.page == page), key=lambda x: x.number)
        assert [x.number for x in own] == list(range(1, len(own) + 1))
        assert [x.first_pos for x in own] == sorted(x.first_pos for x in own)
    assert sum(x.n_uses for x in refs) == 200
    uses = C.uses(frame, "page", "pos", "k", "loc", "id").collect()
    assert len(uses) == 200 and max(u.use_no for u in uses) == max(x.n_uses for x in refs)


def test_backlinks(spark):
    marks = [r[0] for r in spark.range(1).select(F.explode(F.array(*(C.backlinks(F.lit(n)) for n in (1, 2, 28))))).collect()]
    assert marks[:2] == ["^", "a b"] and marks[2].endswith("y z 27 28")


def test_longest_prefix(spark):
    texts = spark.createDataFrame([(1, "Room Draw Process used"), (2, "Room only"), (3, None), (4, "room draw"), (5, "")], "i int, t string")
    terms = spark.createDataFrame([("Room Draw",), ("Room Draw Process",), ("Room",), ("ROOM DRAW",), (None,)], "term string")
    assert {(r.i, r.term) for r in C.longest_prefix(texts, "i", "t", terms, "term").collect()} == {(1, "Room Draw Process")}
    assert C.longest_prefix(texts, "i", "t", terms.where("false"), "term").count() == 0


def test_nearest_capture(spark):
    day = lambda n: datetime.datetime(2020, 1, n)
    cited = spark.createDataFrame([(1, "u", day(5)), (2, "u", day(9)), (3, "v", day(1)), (4, None, day(1)), (5, "u", day(4))], "i long, k string, t timestamp")
    taken = spark.createDataFrame([("u", day(3)), ("u", day(7)), ("u", day(7)), (None, day(1))], "k string, c timestamp")
    assert {(r.row_id, r.captured_at.day) for r in C.nearest_capture(cited, taken, "k", "t", "c", "i").collect()} == {(1, 3), (2, 7), (5, 3)}


def test_catalog_faults_and_precision(spark):
    rows = [(1, 1, "a", "u", None, None, "P"), (1, 2, None, "u", None, None, None), (2, 1, "a", None, None, None, "Q")]
    frame = spark.createDataFrame(rows, "file_ord int, row_ord int, source_key string, url string, parts map<string,string>, held_by string, evidence string")
    assert sorted((r.file_ord, r.row_ord, r.code) for r in K.faults(frame).collect()) == [(1, 1, "key_taken_later"), (1, 2, "no_key"), (2, 1, "no_place"), (2, 1, "unknown_evidence")]
    dates = ["1969", "1969-09", "1969-13", "1969-02-30", "1969-02-28", "spring", "", None]
    shown = spark.createDataFrame([(d,) for d in dates], "d string").select(K.date_precision(F.col("d"))).collect()
    assert [r[0] for r in shown] == ["year", "month", "text", "text", "day", "text", "text", None]
