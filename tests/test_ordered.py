import random

from quirework.operators.ordered import next_text, one_of_each, running_number, running_sum
from quirework.operators.skew import join_keyed


def test_one_of_each_with_maps_nulls_and_ties(spark):
    rows = [("a", 1, {"x": "1"}, "p"), ("a", 2, {"x": "2"}, "q"), ("a", 2, {"x": "3"}, "r"), (None, None, None, "s"), (None, 0, None, None)]
    frame = spark.createDataFrame(rows, "k string, o int, m map<string,string>, v string")
    last = {r.k: (r.o, r.m, r.v) for r in one_of_each(frame, ["k"], ["o"]).collect()}
    assert last == {"a": (2, {"x": "3"}, "r"), None: (0, None, None)}
    first = {r.k: (r.o, r.v) for r in one_of_each(frame, ["k"], ["o"], last=False).collect()}
    assert first == {"a": (1, "p"), None: (None, "s")}


def test_running_forms_by_spans_equal_those_by_group(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "a", None]), p, r.choice(["", "x", "y z"]), r.randrange(3), i) for i, p in enumerate(r.sample(range(5000), 300))]
    frame = spark.createDataFrame(rows, "k string, p long, t string, v int, i int")
    made = {x.i: x for x in next_text(running_sum(running_number(frame, ["k"], "p", "no", 100), ["k"], "p", "v", "total", 100), ["k"], "p", "t", "after", 100).collect()}
    for k in {x[0] for x in rows}:
        total = 0
        own = sorted((x for x in rows if x[0] == k), key=lambda x: x[1])
        for n, row in enumerate(own):
            total += row[3]
            after = next((x[2] for x in own[n + 1 :] if x[2].strip()), "")
            found = made[row[4]]
            assert (found.no, found.total, found.after) == (n + 1, total, after)


def test_join_keyed_is_a_join(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(5000)] + [("cold", 1), ("lone", 2), (None, 3)], "k string, v int")
    keyed = spark.createDataFrame([("hot", 5000, "H"), ("cold", 1, "C"), ("unused", 0, "U")], "k string, n long, w string")
    found = join_keyed(rows, keyed, "k", "n", 5001).groupBy("w").count().collect()
    assert {(r.w, r["count"]) for r in found} == {("H", 5000), ("C", 1)}
