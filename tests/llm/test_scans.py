import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm.line_model import BESIDE, LOOKS, PIECE_PRIOR, PLACES, decode, fit_lines, fit_pieces, furniture_spans
from quirework.llm.scans import BITS, CONFUSED, ODDS_STEPS, OWN_LOOKS, Repairs, clean_field, fitted, folded, is_confusion, mask, misread_words, repaired_text

LINES = "line_id long, doc string, page int, col_no int, line_no int, text string, label string"


@pytest.mark.parametrize(
    ("text", "cleaned", "had"),
    [
        ("It was a\n- 6 -\nbench.", "It was a\nbench.", True), ("It was\nPage 58 of 75\na bench.", "It was\na bench.", True), ("It was\nA Crestling glossary\na bench.", "It was\na bench.", True),
        ("It was PRIMER OF ULDWICK | 153 a bench.", "It was a bench.", True), ("It was [24] A Brackwater glossary a bench.", "It was a bench.", True), ("It was 173 Handbook of Thornavy a bench.", "It was a bench.", True),
        ("It was a libra-\nrian.", "It was a libra-\nrian.", False), ("In 1995 the Handbook of Thornavy was read.", "In 1995 the Handbook of Thornavy was read.", False), ("", "", False),
    ],
)
def test_furniture_in_a_field(text, cleaned, had):
    assert clean_field(text) == (cleaned, had)


@pytest.mark.parametrize("noun", ["Almanac", "Annals", "Chapter", "Magazine", "Report"])
def test_no_noun_is_needed(noun):
    for text in (f"It was The {noun} of the Hall 14 a bench.", f"It was [14] {noun} of Thornavy a bench.", f"It was {noun.upper()} OF ULDWICK | 14 a bench.", f"It was\n{noun} of Uldwick\na bench.", f"It was\n14   {noun} of Uldwick\na bench."):
        assert clean_field(text)[1], text
    assert not clean_field(f"In 1995 the {noun} of Thornavy was read.")[1]


@pytest.mark.parametrize(("word", "meant"), [("frorn", "from"), ("vvith", "with"), ("mar@thon", "marathon"), ("ancliors", "anchors"), ("rnernory", "memory"), ("cl0wncd", "downed"), ("riotified", "notified")])
def test_confusions_are_undone(spark, word, meant):
    assert is_confusion(word, meant) and not is_confusion(meant, word)
    keys = spark.createDataFrame([(word, meant)], "a string, b string").select(folded(F.col("a")), folded(F.col("b"))).collect()[0]
    assert keys[0] == keys[1]


def test_keys_and_confusions_agree_with_brute_force():
    import itertools
    import random

    def undone(word):
        places = [(m, s, t) for s, t in CONFUSED for m in range(len(word) - len(s) + 1) if word.startswith(s, m)]
        made = set()
        for k in range(1, len(places) + 1):
            for chosen in itertools.combinations(sorted(places), k):
                new, at = "", 0
                for place, seen, true in chosen:
                    if place < at:
                        break
                    new, at = new + word[at:place] + true, place + len(seen)
                else:
                    made.add(new + word[at:])
        return made

    r = random.Random(3)
    for _ in range(150):
        word = "".join(r.choice("rnvclie0f1") for _ in range(r.randrange(1, 7)))
        made = undone(word)
        assert all(is_confusion(word, m) for m in made)
        for _ in range(20):
            other = "".join(r.choice("rnmvwcdliuhetof") for _ in range(r.randrange(1, 7)))
            assert is_confusion(word, other) == (other in made or other == word)


def test_misread_words_whatever_their_length_or_number_of_confusions(spark):
    long = "rn" * 30
    vocabulary = [("memory", 400), ("rnernory", 3), ("m" * 30, 900), (long, 5), ("cafe", 40), ("care", 60), ("lafe", 56), ("late", 70), ("l@te", 50), ("post-rn", 9)]
    found = misread_words(spark.createDataFrame(vocabulary, "word string, n long"), spark.createDataFrame([("rnemory",)], "word string"))
    assert {tuple(x) for x in found.collect()} == {("rnernory", "memory"), ("rnemory", "memory"), (long, "m" * 30), ("l@te", "late")}


def test_decoding_is_the_best_of_all_labellings():
    import itertools
    import random

    def weight(scores, labels, beside):
        return sum(s for s, on in zip(scores, labels) if on) + beside * sum(a and b for a, b in itertools.pairwise(labels))

    r = random.Random(5)
    for _ in range(200):
        scores, beside = [r.uniform(-3, 3) for _ in range(r.randrange(0, 8))], r.uniform(-1, 2)
        best = max(weight(scores, labels, beside) for labels in itertools.product((False, True), repeat=len(scores)))
        assert abs(weight(scores, decode(scores, beside), beside) - best) < 1e-9


def test_a_fit_learns_what_the_prior_does_not_know():
    r = np.random.default_rng(1)
    n = 6000
    looks, places = np.zeros((n, len(LOOKS))), np.zeros((n, len(PLACES)))
    pages, line = np.arange(n) // 30, np.arange(n) % 30
    places[line == 0, :4] = [1, 0, 1, 1]
    head = line == 0
    # running heads here are indented and end in a stop, against the prior
    looks[head, list(LOOKS).index("indent")] = looks[head, list(LOOKS).index("punctuation")] = 1
    looks[~head, list(LOOKS).index("lower")] = r.random((~head).sum()) < 0.6
    places[head, list(PLACES).index("in_document")] = r.random(head.sum()) < 0.5
    fitted = fit_lines(looks, places, pages)
    prior = {"bias": 0, **LOOKS, **PLACES}
    assert fitted["indent"] > prior["indent"] and fitted["punctuation"] > prior["punctuation"]
    assert fit_lines(looks[:0], places[:0], pages[:0])["beside"] == BESIDE
    assert fit_pieces([]) == PIECE_PRIOR and furniture_spans("", PIECE_PRIOR) == []


def test_repaired_text():
    splits = [{"first": "lib", "mark": "-", "second": "rary", "is_split": True, "meant": None}, {"first": "well", "mark": "-", "second": "worn", "is_split": False, "meant": None}]
    assert repaired_text("The Lib-\nrary frorn a lib-\n rary, well-\nworn", {"frorn": "from"}, splits) == "The Lib- rary from a library, well-worn"


def book(pages=6):
    words = "the steward praised a quiet bench from the library while many newcomers sang with him".split()
    rows, at = [], 0
    for page in range(1, pages + 1):
        lines = [f"Vellacot Glossary   {page + 40}"]
        lines += [" ".join(words[k % 9 : k % 9 + 6]) for k in range(12)]
        lines[5] = "many newco-" if page < pages else lines[5]
        lines[6] = "mers sang with him the well-" if page < pages else lines[6]
        lines[7] = "worn bench frorn the vvell-worn library" if page == 1 else "worn bench from the well-worn library"
        lines += [f"- {page} -"]
        for n, text in enumerate(lines):
            rows.append((at := at + 1, "book", page, 1, n, text, "x"))
    rows += [(9000 + k, "words", 1, 1, k, "a well-worn bench from a library with well", "x") for k in range(40)]
    return rows


def found(spark, rows, fields=()):
    frames = [("t", "f", spark.createDataFrame(list(fields), "row_id long, text string"))]
    repairs = Repairs(spark.createDataFrame(rows, LINES), frames)
    return repairs, {(r.table_name, r.row_id, r.fault) for r in repairs.faults().collect()}


def test_a_small_book(spark):
    rows = book()
    texts = {r[0]: r[5] for r in rows}
    fields = [(1, "a quiet ben-\nch frorn\n- 7 -\nthe library"), (2, None), (3, ""), (4, "well"), (4, "well"), (5, "x " * 60_000)]
    repairs, faults = found(spark, rows, fields)
    furniture = {i for t, i, f in faults if f == "furniture" and t == "page_lines"}
    assert furniture == {i for i, t in texts.items() if t.startswith(("Vellacot", "- "))}
    broken = {texts[i] for t, i, f in faults if f == "broken_word" and t == "page_lines"}
    assert broken == {"many newco-"}
    misread = {texts[i] for t, i, f in faults if f == "misread" and t == "page_lines"}
    assert misread == {"worn bench frorn the vvell-worn library"}
    assert {(i, f) for t, i, f in faults if t == "t"} == {(1, "furniture"), (1, "broken_word"), (1, "misread")}
    assert {r.row_id: r.repaired for r in repairs.repaired_fields().where("row_id = 1").collect()} == {1: "a quiet bench from the library"}
    text = " ".join(r.text for r in repairs.paragraphs().where("doc = 'book' and page = 1").orderBy("paragraph").collect())
    assert "many newcomers sang with him the well-worn bench from the well-worn library" in text and "Vellacot" not in text


def test_a_page_that_is_cut_gives_what_a_whole_one_gives(spark, monkeypatch):
    rows = [(k, None, None, None, None, f"{['the steward', 'praised it'][k % 2]} and sang many newco-" if k % 5 == 0 else "mers sang with the steward and many newcomers", "x") for k in range(60)]
    whole = found(spark, rows)[1]
    monkeypatch.setattr("quirework.llm.scans.PAGE_LINES", 7)
    assert found(spark, rows)[1] == whole and {f for *_, f in whole} == {"broken_word"} and len(whole) == 12


def test_empty_and_null_lines(spark):
    assert found(spark, [])[1] == set()
    assert found(spark, [(1, None, None, None, None, None, None), (2, "d", 1, 1, 1, "", None)])[1] == set()


def test_mask(spark):
    shown = spark.createDataFrame([("Quiet lectures   146",), ("Quiet 1ectures   148",), ("lxxviii   Quillon Yearbook",), ("lxxx   Quillon Yearb00k",)], "t string").select(mask(F.col("t"))).collect()
    assert shown[0] == shown[1] and shown[2] == shown[3]


def strange_book(pages=40):
    """Heads in lower case that end in a stop, against the prior; every other one comes back."""
    r = random.Random(2)
    name = lambda: "".join(r.choice("bdgklmnprst") + r.choice("aeiou") for _ in range(3))
    rows, at = [], 0
    for page in range(1, pages + 1):
        head = "   the ledger of days;" if page % 2 else f"   the {name()} of {name()};"
        lines = [head, *(f"{name().title()} sang with {name()} and the quiet {name()} that {name()} had {name()} of all {name()}" for _ in range(8))]
        rows += [(at := at + 1, "book", page, 1, n, text, "x") for n, text in enumerate(lines)]
    return rows


def test_labels_do_not_depend_on_the_number_of_lines(spark, monkeypatch):
    rows = strange_book()
    heads = {r[0] for r in rows if r[4] == 0}
    monkeypatch.setattr("quirework.llm.line_model.SAMPLED_LINES", 1, raising=False)
    assert {i for t, i, f in found(spark, rows)[1] if f == "furniture"} == heads


def test_a_fit_on_counts_is_the_fit_on_all_lines(spark):
    r = np.random.default_rng(4)
    n = 3000
    code, odds, page, at = r.integers(0, 2 ** len(BITS), n) & r.integers(0, 2 ** len(BITS), n), np.round(r.uniform(-3, 3, n) * ODDS_STEPS) / ODDS_STEPS, np.arange(n) // 20, np.arange(n) % 20
    rows = [("d", int(p), 0, int(a), int(c), float(o)) for p, a, c, o in zip(page, at, code, odds)]
    lines = spark.createDataFrame(rows + [("d", 0, 0, 50, None, 0.0)], "doc string, page int, chunk int, at int, code int, odds double")
    bits = ((code[:, None] >> np.arange(len(BITS))) & 1).astype(float)
    looks = np.hstack([bits[:, : len(OWN_LOOKS)], np.maximum(odds, 0)[:, None], np.minimum(odds, 0)[:, None]])
    expected = fit_lines(looks, bits[:, len(OWN_LOOKS) :], page)
    assert fitted(lines) == pytest.approx(expected, abs=1e-6)
