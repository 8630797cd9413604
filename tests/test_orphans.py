import datetime
import random

from pyspark.sql import functions as F

from quirework.operators.orphans import Reference, orphan_references, orphans_by_month

CHILD, PARENT = "id long, ref string, at timestamp, key string", "key string, begun timestamp, ended timestamp, at int"


def day(n):
    return datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)


def references(spark, children, parents):
    child, parent = spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT)
    return [Reference(child, "c", "ref", "id", "at", F.col("ref"), parent, "p", "key", "begun", "ended")]


def brute(children, parents):
    lost = set()
    for i, ref, at, _ in children:
        if ref and not any(k == ref and b is not None and at is not None and b <= at and (e is None or e > at) for k, b, e, _ in parents):
            lost.add(i)
    return lost


def test_against_brute_force_with_a_hot_key(spark):
    r = random.Random(1)
    keys = ["hot"] * 6 + ["a", "b", "c", "", None]
    children = [(i, r.choice(keys), day(r.randrange(400)) if r.random() < 0.97 else None, "x") for i in range(600)]
    begun = [r.randrange(380) for _ in range(40)]
    parents = [(r.choice(["hot", "a", "b"]), day(s) if r.random() < 0.95 else None, day(s + r.randrange(9)) if r.random() < 0.9 else None, 1) for s in begun]
    # no key hot; hot keys with a list of steps; hot keys in spans of time
    for group_rows, most_steps in ((10**6, 200), (20, 200), (20, 0), (1, 3)):
        found = orphan_references(references(spark, children, parents), group_rows, most_steps).collect()
        assert sorted(x.row_id for x in found) == sorted(brute(children, parents))


def test_all_rows_of_a_key_at_one_time(spark):
    children = [(i, "k", day(5), "") for i in range(50)] + [(99, "k", day(4), "")]
    parents = [("k", day(5), None, 0), ("k", day(1), day(2), 0)]
    for group_rows, most_steps in ((10**6, 200), (5, 200), (5, 1)):
        found = orphan_references(references(spark, children, parents), group_rows, most_steps).collect()
        assert [(r.row_id, r.state) for r in found] == [(99, "removed")]


def test_states_ties_and_repeats(spark):
    parents = [("k", day(10), day(20), 0), ("k", day(10), day(20), 0), ("late", day(50), None, 0)]
    children = [(1, "k", day(9), ""), (2, "k", day(10), ""), (3, "k", day(20), ""), (3, "k", day(20), ""), (4, "late", day(40), ""), (5, "never", day(1), ""), (6, None, day(1), "")]
    found = orphan_references(references(spark, children, parents))
    assert sorted((r.row_id, r.state) for r in found.collect()) == [(1, "absent"), (3, "removed"), (3, "removed"), (4, "absent"), (5, "absent")]
    months = {(r.month, r.state): r.n_orphans for r in orphans_by_month(found).collect()}
    assert months == {("2020-01", "absent"): 2, ("2020-01", "removed"): 2, ("2020-02", "absent"): 1}


def test_empty_tables(spark):
    assert orphan_references(references(spark, [], [])).count() == 0
    assert orphan_references(references(spark, [(1, "k", day(1), "")], [])).count() == 1
    assert orphan_references(references(spark, [], [("k", day(1), None, 0)])).count() == 0
