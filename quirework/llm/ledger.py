"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

The ledger keeps, in buckets of the key's hash, each canonical key's count and its earliest
representative. A new batch is counted by key first; only the buckets it touches are read, joined
(full outer) with the counts and written anew. A list of which generation has which bucket is
written last, so a lost executor or a broken run leaves the last whole ledger, and a ledger can
be opened again where it lies. What no bucket uses any more is then deleted.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators.skew import join_keyed
from quirework.session import discard, scratch_path, written

#: Buckets of a new ledger, at least, and the keys one is meant to hold.
BUCKETS, BUCKET_KEYS = 8, 1_000_000
#: White space of any kind and punctuation.
IGNORED_JAVA = r"[\p{IsWhite_Space}\p{P}]+"

# Small letters that share their capital with other letters.
FOLDED = {"ß": "ss", "ς": "σ", "ſ": "s"}


def canonical_key(term: Column) -> Column:
    """Equal for terms that differ only in white space, letter case, punctuation and the order
    of the alternatives between slashes. Null for null; a term of nothing but punctuation and
    space has the empty key, so such terms are one another's copies."""
    folded = F.lower(term)
    for letter, plain in FOLDED.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    alternatives = F.split(folded, "/")
    bare = F.transform(alternatives, lambda x: F.regexp_replace(x, IGNORED_JAVA, ""))
    return F.array_join(F.array_sort(F.filter(bare, lambda x: x != "")), "/")


COUNTED = "key string, n bigint, first struct<id: bigint, term: string>"


def counted_by_key(batch: DataFrame, term: str, row_id: str, *also: Column) -> DataFrame:
    """key, n, first (struct of id and term, of the smallest id) and the other columns that it is
    counted by. Rows with a null term have no key."""
    keyed = batch.select(canonical_key(F.col(term)).alias("key"), F.struct(F.col(row_id).cast("bigint").alias("id"), F.col(term).alias("term")).alias("first"), *also)
    others = [c for c in keyed.columns if c not in ("key", "first")]
    return keyed.where("key is not null").groupBy("key", *others).agg(F.count("*").alias("n"), F.min("first").alias("first"))


class Ledger:
    """Counts of canonical keys over all batches added so far. A path where a ledger lies opens it
    as it was left, with its own number of buckets; else a new one is begun there."""

    schema = COUNTED + ", bucket int"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or scratch_path(spark, "ledger")
        self.generation = 0
        #: bucket -> the generation that has its rows; at most `buckets` entries
        self.held: dict[int, int] = {}
        lists = [int(n[5:-5]) for n in self._names(self.path) if n.startswith("list-")]
        if lists:
            found = json.loads(self._io(f"list-{max(lists)}.json"))
            self.generation, self.buckets, self.held = max(lists), found["buckets"], {int(b): g for b, g in found["held"].items()}

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, where: str) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return [s.getPath().getName() for s in self._files().listStatus(root)] if self._files().exists(root) else []

    def _io(self, name: str, text: str | None = None) -> str | None:
        """Writes a small file, or reads it."""
        if text is None:
            return "\n".join(r[0] for r in self.spark.read.text(str(self._path(name))).collect())
        # renamed when it is whole
        with_part = self._path(name + ".part")
        out = self._files().create(with_part, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._files().rename(with_part, self._path(name))
        return None

    def read(self, only: list[int] | None = None) -> DataFrame:
        """key, n, first (struct of id and term) and bucket, of all or some buckets."""
        by_generation: dict[int, list[str]] = {}
        for bucket, generation in self.held.items():
            if only is None or bucket in only:
                by_generation.setdefault(generation, []).append(f"{self.path}/{generation}/bucket={bucket}")
        whole = self.spark.createDataFrame([], self.schema)
        for generation, paths in by_generation.items():
            whole = whole.unionByName(self.spark.read.schema(self.schema).option("basePath", f"{self.path}/{generation}").parquet(*paths))
        return whole

    def add(self, batch: DataFrame, term: str, row_id: str) -> None:
        """Counts a batch into the ledger. Rows with a null term have no key and aren't counted;
        of rows with one key the smallest id represents it. An empty batch changes nothing."""
        self.add_counted(counted_by_key(batch, term, row_id))

    def add_counted(self, counts: DataFrame) -> None:
        """Adds key, n and first of a batch, a row a key. Only the buckets that have one of its keys
        are read and written anew."""
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        more = written(counts.select(bucket.alias("bucket"), "key", F.col("n").alias("more"), F.col("first").alias("new_first")), "ledger-batch")
        # at most as many as there are buckets
        touched = sorted(r[0] for r in more.select("bucket").distinct().collect())
        if touched:
            both = self.read(touched).join(more, ["bucket", "key"], "full_outer")
            merged = both.select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"), F.least("first", "new_first").alias("first"), "bucket")
            new = self.generation + 1
            merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{new}")
            replaced = {b: self.held[b] for b in touched if b in self.held}
            self.held |= dict.fromkeys(touched, new)
            self._io(f"list-{new}.json", json.dumps({"buckets": self.buckets, "held": self.held}))
            self._drop(replaced, new)
            self.generation = new
        discard(more)

    def _drop(self, replaced: dict[int, int], new: int) -> None:
        """Deletes what the new list doesn't name: replaced buckets and the list before."""
        gone = [str(g) for g in set(replaced.values()) if g not in self.held.values()]
        kept = [f"{g}/bucket={b}" for b, g in replaced.items() if str(g) not in gone]
        for name in [*gone, *kept, f"list-{self.generation}.json"]:
            self._files().delete(self._path(name), True)


def ledger_of(entries: DataFrame, term: str, row_id: str, received: str) -> Ledger:
    """The ledger after all of entries, added batch by batch in the order received: a batch is a year
    (rows without a time are the last batch). There are as many as the table has years, so the
    list of them is short. The table is read once: all years are counted by key together."""
    year = F.year(received).alias("year")
    counts = written(counted_by_key(entries, term, row_id, year), "year-counts", ["year"])
    sizes = {r[0]: r[1] for r in counts.groupBy("year").count().collect()}
    ledger = Ledger(entries.sparkSession, buckets=max(BUCKETS, math.ceil(sum(sizes.values()) / BUCKET_KEYS)))
    for y in sorted(sizes, key=lambda y: (y is None, y)):
        ledger.add_counted(counts.where(F.col("year").isNull() if y is None else F.col("year") == y).drop("year"))
    discard(counts)
    return ledger


def copies(entries: DataFrame, ledger: Ledger, term: str, row_id: str) -> DataFrame:
    """first_entry_id and copy_entry_id: every entry but the earliest of each key with two or
    more. Hot keys meet their representative without a shuffle."""
    known = ledger.read()
    total = known.agg(F.sum("n")).collect()[0][0] or 0
    repeated = known.where("n > 1").select("key", "n", F.col("first.id").alias("first_entry_id"))
    rows = entries.select(canonical_key(F.col(term)).alias("key"), F.col(row_id).cast("bigint").alias("copy_entry_id"))
    joined = join_keyed(rows.where("key is not null"), repeated, "key", "n", total)
    return joined.where("copy_entry_id <> first_entry_id").select("first_entry_id", "copy_entry_id")
