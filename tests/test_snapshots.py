import random

from quirework.operators.snapshots import changes, except_all_both_ways

SCHEMA = "no int, term string, ord int, a string, b string, key string"


def found(spark, rows):
    return sorted((r.snapshot_no, r.key, r.change_kind) for r in changes(spark.createDataFrame(rows, SCHEMA), "no", "term", "ord", ["a", "b"]).collect())


def test_kinds_nulls_and_superseded_rows(spark):
    rows = [
        (1, "same", 1, "x", None, ""), (2, "same", 1, "x", None, ""), (1, "gone", 1, "x", "y", ""), (2, "new", 1, None, None, ""),
        (1, "null", 1, None, "y", ""), (2, "null", 1, "", "y", ""), (1, "twice", 1, "old", "y", ""), (1, "twice", 2, "x", "y", ""), (2, "twice", 5, "x", "y", ""),
        (1, None, 1, "x", "y", ""), (2, None, 1, "z", "y", ""), (2, "New", 1, "x", "y", ""), (2, "New", 1, "x", "y", ""), (4, "New", 1, "x", "y", ""),
    ]
    assert found(spark, rows) == sorted([
        (2, "gone", "removed"), (2, "new", "added"), (2, "null", "changed"), (2, "New", "added"),
        (4, "same", "removed"), (4, "new", "removed"), (4, "null", "removed"), (4, "twice", "removed"),
    ])


def test_random_against_dictionaries(spark):
    r = random.Random(2)
    rows = [(n, r.choice("abcdefg"), o, r.choice(["x", "y", None]), r.choice(["u", None]), "k") for n in (1, 2, 3) for o in range(9)]
    want = []
    for n in (2, 3):
        old, new = ({t: (a, b) for m, t, o, a, b, _ in sorted(rows, key=lambda x: x[2]) if m == k} for k in (n - 1, n))
        want += [(n, t, "added" if t not in old else "removed" if t not in new else "changed") for t in {*old, *new} if old.get(t, 0) != new.get(t, 0)]
    assert found(spark, rows) == sorted(want)


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "a", 1, "x", "y", "")]) == []


def test_except_all_counts_copies(spark):
    left, right = (spark.createDataFrame([(x,) for x in rows], "v string") for rows in (["a", "a", "b", None], ["a", "c", None, None]))
    assert {(r.v, r.net) for r in except_all_both_ways(left, right).collect()} == {("a", 1), ("b", 1), ("c", -1), (None, -1)}
