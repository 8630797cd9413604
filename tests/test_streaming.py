import datetime
import uuid

from quirework.streaming.incremental import counts_by_window, fetch_states, new_items


def run(stream, mode="append"):
    name = f"t{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name).collect()


def source(spark, tmp_path, rows, schema, parts=2):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_new_items(spark, tmp_path):
    t = datetime.datetime(2020, 1, 1)
    rows = [("a", t), ("a", t), ("b", t), (None, t)]
    stream = source(spark, tmp_path, rows, "sha string, at timestamp")
    assert sorted(r.sha for r in run(new_items(stream, "sha", "at", "1 day"))) == ["a", "b"]


def test_fetch_states(spark, tmp_path):
    outcomes = ["throttled", "throttled", "fetched"] + ["throttled"] * 5
    stream = source(spark, tmp_path, [("s", i, o) for i, o in enumerate(outcomes)], "stream string, seq long, outcome string", parts=1)
    found = sorted(run(fetch_states(stream)), key=lambda r: r.seq)
    assert [r.failures for r in found] == [1, 2, 0, 1, 2, 3, 4, 5] and [r.stopped for r in found][-2:] == [False, True]


def test_windows(spark, tmp_path):
    t = datetime.datetime(2020, 1, 1)
    rows = [(t + datetime.timedelta(minutes=m), "k") for m in (0, 1, 6, 300)]
    found = run(counts_by_window(source(spark, tmp_path, rows, "at timestamp, kind string", parts=1), "at", "kind", "5 minutes", "1 minute"), "complete")
    assert sorted(r.n for r in found) == [1, 1, 2]
