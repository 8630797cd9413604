import pytest
from pyspark.sql import functions as F

from quirework.operators import manifests as M
from quirework.operators.shapes import judge
from quirework.sources import files, sinks


def test_tsv_editions(spark, tmp_path):
    (tmp_path / "guide-2001.tsv").write_text('term\tdefinition\tsource_key\tlocator\nBench\t"A" seat\tk\tp.1\nGong\n\tno term\n', encoding="utf-8")
    (tmp_path / "_diff.tsv").write_text("term\nx\n", encoding="utf-8")
    found = files.tsv_editions(spark, str(tmp_path)).orderBy("row_ord").collect()
    assert [(r.edition, r.term, r.definition, r.locator) for r in found] == [("guide-2001", "Bench", '"A" seat', "p.1"), ("guide-2001", "Gong", None, None)]


def test_yaml_catalog(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("- key: k1\n  date: 1969\n  parts: {part 1: u}\n- title: no key\n", encoding="utf-8")
    (tmp_path / "b.yaml").write_text("- key: k1\n  date: 1970-01-02\n", encoding="utf-8")
    found = files.yaml_catalog(spark, str(tmp_path)).orderBy("file_ord", "row_ord").collect()
    assert [(r.file_ord, r.row_ord, r.source_key, r.date_raw, r.parts) for r in found] == [(1, 0, "k1", "1969", {"part 1": "u"}), (1, 1, None, None, None), (2, 0, "k1", "1970-01-02", None)]


def test_pages_and_front_matter(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "p.md").write_text('---\ntitle: "A page"\nlabels: a, b\n---\n\nBody --- here\n', encoding="utf-8")
    (tmp_path / "q.md").write_text("No front\n---\n", encoding="utf-8")
    found = sorted(files.pages(spark, str(tmp_path)).collect(), key=lambda r: r.path)
    assert found[0].front is None and found[0].body == "No front\n---\n"
    assert found[1].front == {"title": "A page", "labels": "a, b"} and found[1].body == "Body --- here\n"


def test_form_feeds_and_strict(spark):
    texts = spark.createDataFrame([("d", "one\ftwo\f"), ("e", None)], "doc string, t string")
    assert [(r.page, r.text) for r in files.form_feed_pages(texts, "doc", "t", 5).collect()] == [(5, "one"), (6, "two")]
    assert files.strict(spark.createDataFrame([(1, None)], "a int, b string"), ["a", "b"]).collect()[0] == ("1", "")
    with pytest.raises(ValueError, match="fields"):
        files.strict(spark.range(1), ["a"])


def test_sinks(spark):
    rows = spark.createDataFrame([(" a\tb\n", None, "k|x", "p.1")], "term string, definition string, source_key string, locator string")
    assert sinks.tsv_lines(rows).collect()[0][0] == "a b\t\tk|x\tp.1"
    assert sinks.markdown_rows(rows, ["source_key", "definition"]).collect()[0][0] == "| k·x |  |"
    page = spark.createDataFrame([("a<b>old</b>c<b>two</b>",), ("no marks",), (None,)], "p string")
    once = sinks.spliced(F.col("p"), "<b>", "</b>", F.lit("new"))
    assert [r[0] for r in page.select(once).collect()] == ["a<b>\nnew\n</b>c<b>two</b>", None, None]
    assert page.select(once.alias("p")).select(once).collect()[0][0] == "a<b>\nnew\n</b>c<b>two</b>"
    links = spark.createDataFrame([("a/b/x.md", "a/c/y.png"), ("x.md", "y.md"), ("a/x.md", "b.md")], "p string, t string")
    assert [r[0] for r in links.select(sinks.relative_link(F.col("t"), F.col("p"))).collect()] == ["../c/y.png", "y.md", "../b.md"]


def test_manifests(spark):
    lines = [("c", 1, "a\tb\tx"), ("c", 2, "1"), ("p", 1, "f\tu"), ("p", 2, "g\tv"), ("s", 1, "f\tu"), ("s", 2, "ragged"), ("n", 1, None)]
    found = M.sniff(spark.createDataFrame(lines, "f string, o int, l string"), "f", "o", "l", ["a", "b"]).collect()
    assert {r.f: r.layout for r in found} == {"c": "records", "p": "pairs", "s": "skipped", "n": "skipped"}
    items = spark.createDataFrame([(1, "g", "A b"), (2, "g", "a-B"), (3, "g", "!"), (4, "h", None), (5, "g", "a b 2"), (6, "g", "a b")], "id int, g string, t string")
    names = {r.id: r.name for r in M.slugged(items, "g", "t", "id").collect()}
    assert names == {1: "a-b", 2: "a-b-2", 3: "img", 4: "img", 5: "a-b-2-2", 6: "a-b-3"}
    old = spark.createDataFrame([("k", "x", "y"), ("l", "x", "y")], "k string, a string, b string")
    new = spark.createDataFrame([("k", 1, "first", ""), ("k", 2, "last", None), ("z", 1, "no", "no")], "k string, o int, a string, b string")
    assert sorted(M.keyed_update(old, new, "k", ["a", "b"], ["o"]).collect()) == [("k", "last", "y"), ("l", "x", "y")]
    assert [r.k for r in M.missing(new.select("k").distinct(), old, "k").collect()] == ["z"]
    assert M.signed_limit(spark.range(10), ["id"], -3).count() == 7 and M.signed_limit(spark.range(10), ["id"], 3).count() == 3


def test_shapes(spark):
    glyphs = [("f", s, e, n, o) for o, (s, e, n) in enumerate([("1", "a", 2), ("1", "b", 2), ("2", "x", 1), ("3", "y", 1), ("", "z", 9)])] + [("g", "1", "a", 1, 9)]
    reference = spark.createDataFrame([("1", "a", 1), ("1", "q", 2), ("2", "b", 1), ("3", "c", 1)], "shape string, meant string, ord int")
    found = {r.font: (r.n_matched, r.n_agreeing, r.broken) for r in judge(spark.createDataFrame(glyphs, "font string, shape string, extracted string, n long, ord int"), reference).collect()}
    assert found == {"f": (3, 1, True), "g": (1, 1, False)}
