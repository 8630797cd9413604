import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.functions import text as X


def one(spark, value, *functions):
    frame = spark.createDataFrame([(value,)], "t string")
    return frame.select(*(f(F.col("t")).alias(str(i)) for i, f in enumerate(functions))).collect()[0]


@pytest.mark.parametrize(
    ("term", "key"),
    [("  The Bench, of  Oak!", "the bench of oak"), ("Café", "caf"), ("", ""), (None, None), ("THE GONG", "gong"), ("the drum", "the drum")],
)
def test_normalise_term(spark, term, key):
    assert one(spark, term, lambda c: X.normalise_term(c, {"old gong": "gong"}))[0] == key


def test_null_in_null_out(spark):
    functions = (X.normalise_definition, X.slugify, lambda c: X.shorten(c, 5), X.html_escape, X.html_unescape, X.html_to_text, X.ligatures, X.shifted_decode, X.without_fences, X.looks_like_term)
    assert list(one(spark, None, *functions)) == [None] * len(functions)
    assert one(spark, "", *functions)[0] == ""


def test_very_long_text(spark):
    text = "word & " * 200_000
    escaped, short = one(spark, text, X.html_escape, lambda c: X.shorten(c, 10))
    assert escaped == html.escape(text) and short == "word & wo…"


def test_bytes(spark):
    rows = ["naïve".encode(), b"\x93na\xefve\x94", b"na\xefve\x81", b"", None]
    frame = spark.createDataFrame([(r,) for r in rows], "b binary")
    assert [r[0] for r in frame.select(X.decode_bytes(F.col("b"))).collect()] == ["naïve", "“naïve”", "naïve\x81", "", None]


@settings(max_examples=25, deadline=None)
@given(text=st.text(alphabet="ab&<>\"' ;lt#x2", max_size=30))
def test_unescape_undoes_escape(spark, text):
    assert one(spark, text, lambda c: X.html_unescape(X.html_escape(c)))[0] == text


def test_html_quirks(spark):
    page = "<style>x</style><!-- <p>a</p> --><link rel=x>b<br clear=all>c<br />d</P >e < f > g &lt;b&gt;\xa0\xa0h"
    assert one(spark, page, X.html_to_text)[0] == "- b c\nd e g <b> h"


def test_dehyphenate(spark):
    cases = [(["Exam-", "ple of a", "", " line  two "], "Example of a line two"), (["self-", "made-up"], "self- made-up"), (["A-", "B"], "A- B"), ([], ""), (["x-"], "x-")]
    frame = spark.createDataFrame([(c,) for c, _ in cases], "l array<string>")
    assert [r[0] for r in frame.select(X.dehyphenate(F.col("l"))).collect()] == [w for _, w in cases]


def test_evidence_tags_and_fences(spark):
    assert one(spark, "[P] a [R](x.md) [T][Q]", X.evidence_tags)[0] == ["P", "T"]
    assert one(spark, "a\n```\n[@k]\n```\nb", X.without_fences)[0] == "a\n\nb"


def test_term_heuristic(spark):
    like = ["Pumpkin caroling", "Bench of the Oak", "KTRU (KAY-true)", "21 Club"]
    unlike = ["a sentence", "Ends here.", "1. Numbered", "Closing)", "x" * 41, "Very Many words in small letters here", ""]
    for text in like + unlike:
        assert one(spark, text, X.looks_like_term)[0] is (text in like), text


def test_page_urls_and_archive(spark):
    assert one(spark, "docs/a/index.md", lambda c: X.page_url(c, "https://s/"))[0] == "https://s/a/"
    assert one(spark, "docs/index.md", lambda c: X.page_url(c, "https://s/"))[0] == "https://s/"
    assert one(spark, "docs/a/b.md", lambda c: X.page_url(c, "https://s/"))[0] == "https://s/a/b/"
    assert one(spark, "https://x.org/a", lambda c: X.archived_link(c, ["x.org"]))[0] == "https://x.org/a"
    assert one(spark, "https://y.org/a", lambda c: X.archived_link(c, ["x.org"]))[0] == "https://web.archive.org/web/2/https://y.org/a"


@settings(max_examples=25, deadline=None)
@given(text=st.text(max_size=40))
def test_normalising_twice_is_normalising_once(spark, text):
    once, twice = one(spark, text, X.normalise_definition, lambda c: X.normalise_definition(X.normalise_definition(c)))
    assert once == twice and not re.search(r"  ", once)


def test_shifted_text(spark):
    assert one(spark, "see WKHEHVW ok", X.shifted_decode)[0] == "see WKHEHVW ok"
    assert one(spark, "see WKHEHVWG ok", X.shifted_decode)[0] == "see ⟨thebestd⟩ ok"
    assert one(spark, "a WKH\x03HQG. b", X.shifted_spaces_decode)[0] == "a the endK b"
    assert one(spark, "plain", X.shifted_spaces_decode)[0] == "plain"


def test_warnings(spark):
    frame = spark.createDataFrame([("a term.", ""), ("Good", "A fine one."), ("x" * 41, "y" * 601), (None, None)], "t string, d string")
    found = [r[0] for r in frame.select(X.entry_warnings(F.col("t"), F.col("d"))).collect()]
    assert found == [["no definition", "term starts in lower case", "term ends in punctuation"], [], ["long term", "term starts in lower case", "long definition", "definition starts in lower case"], ["no definition"]]
