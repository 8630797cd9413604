import random

import numpy as np
import pytest

from quirework.llm.near_duplicates import NearDuplicates, components, leaves, most_common
from quirework.llm.words import WORD, words


def shingles(text, size=3):
    found = WORD.findall((text or "").lower())
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}


def similar(texts):
    sets = {i: s for i, t in texts if (s := shingles(t))}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def corpus(n, seed):
    r = random.Random(seed)
    stock = [f"the rule of {a} is simple and no {b} may leave the {c}" for a in "ab" for b in "cd" for c in "ef"]
    rows = []
    for i in range(n):
        base = [r.choice(stock)] + [f"w{r.randrange(4000)}" for _ in range(r.randrange(5, 25))]
        rows.append(" ".join(base))
        if r.random() < 0.4:
            edited = rows[-1].split()
            for _ in range(r.randrange(4)):
                edited[r.randrange(len(edited))] = f"e{r.randrange(99)}"
            rows.append(" ".join(edited))
    rows += ["hot text that is copied again and again"] * 60 + ["", None, "two words", "A, b!"]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def texts():
    return corpus(220, 1)


@pytest.fixture(scope="module")
def near(spark, texts):
    frame = spark.createDataFrame(texts, "row long, body string")
    return NearDuplicates(frame, "row", "body", 3, (1, 2))


def test_pairs_are_those_of_brute_force(near, texts):
    found = [tuple(r) for r in near.pairs().collect()]
    true = similar(texts)
    assert len(found) == len(set(found)) and set(found) <= true
    assert len(set(found)) >= 0.99 * len(true)


def test_groups_join_what_pairs_join(near, texts):
    rows = near.groups().collect()
    assert sorted(r.id for r in rows) == [i for i, _ in texts]
    parent = {i: i for i, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in [tuple(r) for r in near.pairs().collect()]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert {r.id: r.group_id for r in rows} == {i: root(i) for i, _ in texts}
    assert max(r.n_copies for r in rows) >= 60


@pytest.fixture(scope="module")
def variants():
    r, base, rows = random.Random(7), [f"b{k}" for k in range(40)], set()
    while len(rows) < 1100:
        # runs of changed words, so that similarities lie on both sides of the threshold
        edited, at, n = list(base), r.randrange(40), r.randrange(6, 20)
        edited[at : at + n] = [f"x{r.randrange(10**6)}" for _ in edited[at : at + n]]
        rows.add(" ".join(edited))
    rows = list(enumerate(sorted(rows)))
    return rows, similar(rows)


@pytest.mark.parametrize("block", [1024, 200])
def test_all_pairs_among_many_variants_of_one_text(spark, monkeypatch, variants, block):
    monkeypatch.setattr("quirework.llm.near_duplicates.BLOCK", block, raising=False)
    rows, true = variants
    near = NearDuplicates(spark.createDataFrame(rows, "row long, body string"), "row", "body", 3, (1, 2))
    found = [tuple(p) for p in near.pairs().collect()]
    assert len(found) == len(set(found)) and set(found) <= true
    assert len(true) > 50_000 and len(found) / len(true) >= 0.9999


@pytest.mark.parametrize(("stock", "own", "rows"), [(8, 4, 1000), (20, 10, 600)])
def test_stock_wording_that_all_rows_share(spark, stock, own, rows):
    texts = [(i, " ".join([f"s{k}" for k in range(stock)] + [f"w{i}x{k}" for k in range(own)])) for i in range(rows)]
    one, other = (shingles(texts[k][1]) for k in (0, 1))
    threshold = (len(one & other), len(one | other))
    near = NearDuplicates(spark.createDataFrame(texts, "row long, body string"), "row", "body", 3, threshold)
    assert near.links.count() == rows * (rows - 1) // 2


def test_a_region_too_large_for_a_task(spark, monkeypatch, texts):
    monkeypatch.setattr("quirework.llm.near_duplicates.HELD", 40)
    monkeypatch.setattr("quirework.llm.near_duplicates.REGION", 4)
    near = NearDuplicates(spark.createDataFrame(texts, "row long, body string"), "row", "body", 3, (1, 2))
    assert {tuple(r) for r in near.pairs().collect()} == similar(texts)


def test_many_copies(spark, monkeypatch, texts):
    monkeypatch.setattr("quirework.llm.near_duplicates.BROADCAST_IDS", 3)
    near = NearDuplicates(spark.createDataFrame(texts, "row long, body string"), "row", "body", 3, (1, 2))
    assert {tuple(r) for r in near.pairs().collect()} == similar(texts)


def test_bitmaps_never_reject_a_true_pair():
    r = np.random.default_rng(2)
    for _ in range(300):
        a, b = (set(r.integers(0, 60, r.integers(1, 50)).tolist()) for _ in range(2))
        differ = len({x % 16 for x in a} ^ {x % 16 for x in b})
        assert most_common(np.array([len(a)]), np.array([len(b)]), np.array([differ]))[0] >= len(a & b)


def test_empty_table(spark):
    none = NearDuplicates(spark.createDataFrame([], "row long, body string"), "row", "body", 3, (1, 2))
    assert none.pairs().count() == 0 and none.groups().count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 6), (6, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}


def test_leaves_deepen_where_many_share():
    labels = np.array([[1, k % 3, k, 0] for k in range(30)] + [[2, 0, 0, 0]], np.uint32)
    order = np.lexsort(labels.T[::-1])
    leaf = leaves(labels[order], np.zeros(31, int), most=12)
    assert len(set(leaf)) == 4 and all(n <= 12 for n in np.unique(leaf, return_counts=True)[1])


@pytest.mark.parametrize("text", ["", None, "Déjà-vu: 2nd x_y İstanbul", "a" * 100_000, "１２ ａｂ½²"])
def test_words_are_runs_of_letters_and_digits(text):
    assert words(text) == WORD.findall((text or "").lower())
