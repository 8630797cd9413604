import datetime

from pyspark.sql import functions as F

from quirework.llm.ledger import Ledger, canonical_key, copies, ledger_of

SCHEMA = "entry long, term string, at timestamp, key string, n string"


def rows():
    day = lambda m: datetime.datetime(2020, m, 1)
    terms = ["The Bench", "the  bench!", "Gong/Old Hall", "old-hall / GONG", "Bench", None, "", "!?", "Straße", "STRASSE", "The\xa0Bench"]
    return [(i, t, day(1 + i % 12) if i % 5 else None, "k", "n") for i, t in enumerate(terms)] + [(100 + i, "hot", day(1 + i % 12), "k", "n") for i in range(50)]


def test_copies_and_counts(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    ledger = ledger_of(frame, "term", "entry", "at")
    found = sorted(tuple(r) for r in copies(frame, ledger, "term", "entry").collect())
    assert found == sorted([(0, 1), (0, 10), (2, 3), (6, 7), (8, 9), *((100, 100 + i) for i in range(1, 50))])
    counts = {r["first"].id: r.n for r in ledger.read().collect()}
    assert counts == {0: 3, 2: 2, 4: 1, 6: 2, 8: 2, 100: 50}


def test_batches_in_any_number_give_one_ledger(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    once, thrice = Ledger(spark, buckets=4), Ledger(spark, buckets=4)
    once.add(frame, "term", "entry")
    for k in (2, 0, 1):
        thrice.add(frame.where(F.col("entry") % 3 == k), "term", "entry")
    thrice.add(frame.where("false"), "term", "entry")
    assert sorted(once.read().collect()) == sorted(thrice.read().collect())


def test_a_ledger_opened_again_goes_on(spark, tmp_path):
    frame = spark.createDataFrame(rows(), SCHEMA)
    once = Ledger(spark, buckets=4)
    once.add(frame, "term", "entry")
    where = f"file://{tmp_path}/ledger"
    for k in range(4):
        # each batch goes to a ledger that knows only what lies in the folder
        Ledger(spark, where, buckets=4 if k == 0 else 99).add(frame.where(F.col("entry") % 4 == k), "term", "entry")
    again = Ledger(spark, where)
    assert again.buckets == 4 and sorted(again.read().collect()) == sorted(once.read().collect())
    lying = {p.name for p in (tmp_path / "ledger").iterdir() if not p.name.startswith(".")}
    assert {n for n in lying if n.startswith("list-")} == {f"list-{again.generation}.json"}
    assert {n for n in lying if n.isdigit()} == {str(g) for g in again.held.values()}


def test_only_touched_buckets_are_written(spark):
    ledger = Ledger(spark, buckets=16)
    ledger.add(spark.createDataFrame([(i, f"term {i}") for i in range(200)], "entry long, term string"), "term", "entry")
    before = dict(ledger.held)
    ledger.add(spark.createDataFrame([(500, "Term 3"), (501, "term-3")], "entry long, term string"), "term", "entry")
    changed = [b for b in before if before[b] != ledger.held[b]]
    assert len(before) == 16 and len(changed) == 1
    assert {r.key: r.n for r in ledger.read().where("n > 1").collect()} == {"term3": 3}


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert copies(frame, ledger_of(frame, "term", "entry", "at"), "term", "entry").count() == 0


def test_keys_of_long_text(spark):
    assert spark.range(1).select(F.length(canonical_key(F.repeat(F.lit("A b-"), 100_000)))).collect()[0][0] == 200_000
