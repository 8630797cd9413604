import random

from quirework.llm import leakage
from quirework.llm.words import WORD


def brute(documents, items, size=12):
    grams = lambda t: {tuple(w[i : i + size]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - size + 1)}
    held = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in documents for i, g in held.items() if g & grams(t)}


def tables(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(8, 40)))) for i in range(25)] + [(98, None), (99, "")]
    items += [(50, items[0][1])]
    documents = []
    for d in range(120):
        words = [r.choice(vocabulary) for _ in range(r.randrange(60))]
        if r.random() < 0.5:
            piece = r.choice(items[:20])[1].split()
            cut = piece[r.randrange(4) : r.randrange(10, 40)]
            words[10:10] = [w.upper() + r.choice(["", ",", " — "]) for w in cut]
        documents.append((d, " ".join(words)))
    return documents + [(200, None), (201, ""), (202, documents[0][1])], items


def frames(spark, documents, items):
    return spark.createDataFrame(documents, "doc long, body string"), spark.createDataFrame(items, "item long, body string")


def test_against_brute_force_in_one_and_many_blocks(spark, monkeypatch):
    documents, items = tables(1)
    true = brute(documents, items)
    assert true
    for most in (10**6, 40, 5):
        monkeypatch.setattr(leakage, "BLOCK_WINDOWS", most)
        found = leakage.leaks(*frames(spark, documents, items), "doc", "body", "item", "body").collect()
        assert sorted((r.doc, r.item) for r in found) == sorted(true)


def test_cleaned_documents_leak_no_more(spark, monkeypatch):
    documents, items = tables(2)
    docs, tests = frames(spark, documents, items)
    before, size = dict(documents), 12
    true = {}
    for d, text in documents:
        found = WORD.findall((text or "").lower())
        grams = {tuple(w[k : k + size]) for _, t in items for w in [WORD.findall((t or "").lower())] for k in range(len(w) - size + 1)}
        taken = {k + n for k in range(len(found) - size + 1) if tuple(found[k : k + size]) in grams for n in range(size)}
        if taken:
            true[d] = [w for k, w in enumerate(found) if k not in taken]
    # one block, many, and blocks smaller than an item
    for most in (10**6, 40, 5):
        monkeypatch.setattr(leakage, "BLOCK_WINDOWS", most)
        rows = leakage.without_leaks(docs, tests, "doc", "body", "item", "body").collect()
        assert len(rows) == len(true)
        assert {r.doc: WORD.findall(r.cleaned.lower()) for r in rows} == true
        assert all(r.n_removed == len(WORD.findall(before[r.doc])) - len(true[r.doc]) for r in rows)


def test_empty_tables(spark):
    documents, items = frames(spark, [], [(1, "a " * 20)])
    assert leakage.leaks(documents, items, "doc", "body", "item", "body").count() == 0
    documents, items = frames(spark, [(1, "a " * 20)], [])
    assert leakage.leaks(documents, items, "doc", "body", "item", "body").count() == 0
