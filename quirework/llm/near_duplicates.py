"""Near-duplicate records by an LSH forest.

Each text is a set of shingles (runs of words); its signature is 64 minima under random hash
functions. Each tree of the forest is one sorted order of the signatures, led by other minima.
Candidates are neighbours that share a prefix in some order. How long a prefix is asked depends
on the region: one minimum where few texts share it, up to four where many do, so stock wording
costs little and rare wording finds all its partners.

A longer prefix loses pairs, so every text that met one in some tree also goes through an exact
join: by the prefix filter, two sets that reach the threshold share one of the first shingles of
both, whatever the order; rare shingles come first, so few texts meet. The same join takes what
the sorted orders are cut at: regions that lie across two tasks, and prefixes that are whole and
still shared by many. So no region is too large for a task and none is compared all with all.

Candidates are held against bitmaps of their sets, whose difference bounds the overlap from
above and never rejects a true pair, and then against the sets.

Texts with equal shingle sets are one class from the start, so a text copied a million times is
one row here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.words import window_hashes, word_hashes, words
from quirework.operators.skew import join_keyed
from quirework.session import discard, written

FUNCTIONS, TREES, DEPTH = 64, 16, 4
#: A prefix that more rows than this share is extended by another minimum.
REGION = 256
#: Rows of a sorted order that a task holds together; a region of more goes to the exact join.
HELD = 65_536
#: 64-bit words of a set's bitmap.
BITS = 4
#: The exact join orders shingles by counts in so many buckets, over about so many sets. Both only
#: decide how few texts meet: any order gives the same pairs.
COUNTED, SAMPLED = 2**20, 20_000
#: Rows of one shingle that meet in one block, and buckets in which its rows are counted.
BLOCK, POSTED = 1024, 2**16
#: Up to so many ids or bitmaps (48 MB) are broadcast.
BROADCAST_IDS = 1_000_000

_random = np.random.Generator(np.random.PCG64(20160))
_MULTIPLY = _random.integers(1, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**63, FUNCTIONS, dtype=np.uint64)

_BIT_COLUMNS = [f"b{k}" for k in range(BITS)]
SIGNED = "shingles array<bigint>, set_key bigint, n int, " + ", ".join(f"{b} bigint" for b in _BIT_COLUMNS)


def signed(texts: list[str | None], size: int) -> list[pa.Array]:
    """Of each text: its sorted distinct shingle hashes, their key, number and bitmap."""
    found = [words(t) for t in texts]
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    hashes = window_hashes(word_hashes([w for f in found for w in f]), size)
    # windows that lie in one text
    inside = owner[: len(hashes)] == owner[size - 1 :] if len(hashes) else np.empty(0, bool)
    owner, hashes = owner[: len(hashes)][inside], hashes[inside]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])] if len(hashes) else np.empty(0, bool)
    owner, hashes = owner[new], hashes[new]
    n = np.bincount(owner, minlength=len(texts)).astype(np.int32)
    ends = np.r_[0, np.cumsum(n)]
    keys = [xxhash.xxh64_intdigest(hashes[a:b].tobytes()) - 2**63 if b > a else None for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    bit = (hashes >> np.uint64(32)) % np.uint64(64 * BITS)
    bits = np.zeros((len(texts), BITS), np.uint64)
    np.bitwise_or.at(bits, (owner, (bit // np.uint64(64)).astype(np.int64)), np.uint64(1) << (bit % np.uint64(64)))
    shingles = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int64)))
    return [shingles, pa.array(keys, pa.int64()), pa.array(n), *(pa.array(bits[:, k].view(np.int64)) for k in range(BITS))]


def sign(texts: DataFrame, row_id: str, text: str, shingle_words: int) -> DataFrame:
    """id and SIGNED of every row, in one pass without a shuffle. A null, empty or too short
    text has no shingles and a null key."""
    names = ["id", *(c.split()[0] for c in SIGNED.split(", "))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["id"], *signed(batch["text"].to_pylist(), shingle_words)], names=names)

    return texts.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(each, "id bigint, " + SIGNED)


def minima(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The FUNCTIONS minima of each set, none of them empty, a row a set."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((FUNCTIONS, len(sizes)), np.uint32)
    with np.errstate(over="ignore"):
        for f in range(FUNCTIONS):
            out[f] = np.minimum.reduceat(((flat * _MULTIPLY[f] + _ADD[f]) >> np.uint64(32)).astype(np.uint32), starts)
    return np.ascontiguousarray(out.T)


FOREST = "tree int, label binary, id bigint, n int, x bigint, y bigint"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets to a row for each tree: the label is the minima that lead the tree's order, big-endian
    so that it sorts; x and y are the bitmap folded in two words."""
    names = [c.split()[0] for c in FOREST.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch["n"].to_numpy(zero_copy_only=False)
        found = minima(batch["shingles"].flatten().to_numpy().view(np.uint64), sizes).astype(">u4")
        bits = [batch[b].to_numpy(zero_copy_only=False) for b in _BIT_COLUMNS]
        folded = [np.bitwise_or.reduce(bits[k::2]) for k in (0, 1)]
        width, offsets = 4 * DEPTH, np.arange(0, len(sizes) + 1, dtype=np.int32) * 4 * DEPTH
        for tree in range(TREES):
            label = np.ascontiguousarray(found[:, DEPTH * tree : DEPTH * (tree + 1)]).tobytes()
            assert len(label) == width * len(sizes)
            labels = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(label)])
            columns = [pa.array(np.full(len(sizes), tree, np.int32)), labels, batch["id"], pa.array(sizes.astype(np.int32)), *map(pa.array, folded)]
            yield pa.record_batch(columns, names=names)


def leaves(labels: np.ndarray, trees: np.ndarray, most: int = REGION) -> np.ndarray:
    """The leaf of each row of a sorted run: the shortest prefix that at most `most` rows share.
    Where even the whole label is shared by more, each row is a leaf of its own (below 0)."""
    n = len(labels)
    leaf = np.full(n, -1, np.int64)
    new = np.empty(n, bool)
    new[0], new[1:] = True, trees[1:] != trees[:-1]
    for depth in range(labels.shape[1]):
        new[1:] |= labels[1:, depth] != labels[:-1, depth]
        run = np.cumsum(new) - 1
        fits = (np.bincount(run)[run] <= most) & (leaf < 0)
        leaf[fits] = run[fits] * DEPTH + depth
    alone = leaf < 0
    leaf[alone] = -1 - np.arange(alone.sum())
    return leaf


def most_common(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """The most shingles that two sets can have in common, given the bits in which they differ."""
    return np.minimum(np.minimum(n_a, n_b), (n_a + n_b - differ) // 2)


def neighbours(ids: np.ndarray, leaf: np.ndarray, n: np.ndarray, bits: np.ndarray, threshold: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of one leaf that their bitmaps allow, by their distance in the order."""
    top, bottom = threshold
    at, distance = np.arange(len(ids)), 1
    while len(at):
        at = at[at + distance < len(ids)]
        at = at[leaf[at] == leaf[at + distance]]
        for a in np.array_split(at, max(1, len(at) // 50_000)):
            b = a + distance
            common = most_common(n[a], n[b], np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64))
            near = common * (top + bottom) >= (n[a] + n[b]) * top
            a, b = ids[a[near]], ids[b[near]]
            if len(a):
                yield np.minimum(a, b), np.maximum(a, b)
        distance += 1


def _scan(threshold: tuple[int, int]):
    """Sorted rows to candidate pairs, and to each id that goes to the exact join, with a null b:
    those a prefix longer than one minimum was asked of, and those of a region (one minimum) that
    lies across two tasks or has more than HELD rows. Repeats are dropped in each run."""

    def pairs(table: pa.Table, cut_first: bool, cut_last: bool) -> Iterator[pa.RecordBatch]:
        labels = np.frombuffer(b"".join(table["label"].to_pylist()), ">u4").reshape(-1, DEPTH)
        trees, ids, n = (table[c].to_numpy() for c in ("tree", "id", "n"))
        bits = np.stack([table[c].to_numpy().view(np.uint64) for c in ("x", "y")], axis=1)
        leaf = leaves(labels, trees)
        deep = (leaf % DEPTH > 0) | (leaf < 0)
        same = lambda k: (trees == trees[k]) & (labels[:, 0] == labels[k, 0])
        if cut_first:
            deep |= same(0)
        if cut_last:
            deep |= same(-1)
        for a, b in neighbours(ids, leaf, n.astype(np.int64), bits, threshold):
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
        deep = np.unique(ids[deep])
        yield pa.record_batch([pa.array(deep), pa.nulls(len(deep), pa.int64())], names=["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, cut = 0, True
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows <= HELD:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = table["tree"][-1].as_py(), table["label"][-1].as_py()[:4]
            keep = rows
            while keep and (table["tree"][keep - 1].as_py(), table["label"][keep - 1].as_py()[:4]) == last:
                keep -= 1
            yield from pairs(table.slice(0, keep or rows), cut, not keep)
            cut = not keep
            held, rows = (table.slice(keep).to_batches(), rows - keep) if keep else ([], 0)
        if rows:
            yield from pairs(pa.Table.from_batches(held).combine_chunks(), cut, True)

    return task


def prefixes(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """shingle, id, n (size of the set) and rest (its shingles from this one on) for the first
    shingles of each set, rare ones first: as many as a set that reaches the threshold with this
    one can't miss all of."""
    top, bottom = threshold
    every = max(sets.count() // SAMPLED, 1)
    sampled = sets.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(F.explode("shingles").alias("shingle"))
    # at most COUNTED rows come to the driver
    found = sampled.groupBy(F.pmod("shingle", F.lit(COUNTED)).alias("bucket")).count().toArrow()
    counts = np.zeros(COUNTED, np.int64)
    counts[found["bucket"].to_numpy()] = found["count"].to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(counts)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.list_value_length(batch["shingles"]).to_numpy().astype(np.int32)
            flat = batch["shingles"].flatten().to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, sent.value[flat & (COUNTED - 1)], owner))
            rest = np.repeat(np.cumsum(n), n) - np.arange(len(flat))
            first = np.flatnonzero(rest >= (n * np.int64(top) + bottom - 1)[owner] // bottom)
            of = owner[first]
            columns = [flat[order][first], batch["id"].to_numpy()[of], n[of], rest[first].astype(np.int32)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["shingle", "id", "n", "rest"])

    return sets.select("id", "shingles").mapInArrow(each, "shingle bigint, id bigint, n int, rest int")


def overlapping(sets: DataFrame, only: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs a < b of the ids in `only`: all that reach the threshold, and others; repeated.

    Two sets meet where they share a shingle of their prefixes and enough shingles follow. The
    rows of a shingle meet in blocks of about BLOCK rows, each block with each.
    """
    top, bottom = threshold
    listed = F.broadcast(only) if only.count() <= BROADCAST_IDS else only
    posted = written(prefixes(sets.join(listed, "id", "left_semi"), threshold), "prefixes")
    bucket = F.pmod("shingle", F.lit(POSTED))
    # where many shingles fall in each bucket, only what stands out is cut
    limit = max(BLOCK, 8 * posted.count() // POSTED)
    hot = posted.groupBy(bucket.alias("bucket")).count().where(F.col("count") > limit)
    # fewer than POSTED rows
    hot = F.broadcast(hot.select("bucket", F.ceil(F.col("count") / limit).alias("blocks")))
    rows = posted.withColumn("bucket", bucket).join(hot, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.select("shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "rest")
    left = rows.withColumnsRenamed({"id": "a", "n": "n_a", "rest": "rest_a", "block": "block_a"})
    right = rows.withColumnsRenamed({"id": "b", "n": "n_b", "rest": "rest_b", "block": "block_b"})
    met = left.join(right, ["shingle", "i", "j"]).where("a < b and (i = j or block_a <> block_b)")
    # the shingles in common are at most those that follow the first of them
    return met.where(F.least("rest_a", "rest_b") * (top + bottom) >= (F.col("n_a") + F.col("n_b")) * top).select("a", "b"), posted


def candidates(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Distinct pairs a < b of ids that the forest holds near, or that may reach the threshold
    where it asked for a longer prefix. Each sorted order is cut in even ranges, so no task has
    more of a common prefix than of a rare one."""
    rows = sets.select("id", "shingles", "n", *_BIT_COLUMNS).mapInArrow(_forest, FOREST)
    ordered = rows.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    scanned = written(ordered.mapInArrow(_scan(threshold), "a bigint, b bigint").distinct(), "scanned")
    deep = scanned.where("b is null").select(F.col("a").alias("id"))
    met, posted = overlapping(sets, deep, threshold)
    found = scanned.where("b is not null").unionByName(met).distinct()
    allowed = written(within_bitmaps(found, sets, threshold), "allowed")
    discard(scanned, posted)
    return allowed


def within_bitmaps(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose bitmaps allow them to reach the threshold; none that does is lost. As many
    shingles are in one set alone as bits differ, at least."""
    top, bottom = threshold
    bits = sets.select("id", "n", *_BIT_COLUMNS)
    if bits.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        bits = F.broadcast(bits)
    side = lambda name: bits.select(*(F.col(c).alias(f"{c}_{name}" if c != "id" else name) for c in bits.columns))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    differ: Column = F.lit(0)
    for b in _BIT_COLUMNS:
        differ = differ + F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b")))
    total = F.col("n_a") + F.col("n_b")
    common = F.least("n_a", "n_b", F.floor((total - differ) / 2))
    return both.where(common * (top + bottom) >= total * top).select("a", "b")


class NearDuplicates:
    """The classes of equal texts and the similar pairs of their representatives.

    members: id, rep (the smallest id of the same shingle set). links: a, b, common, both (sizes
    of intersection and union) for representatives whose similarity is at least the threshold,
    verified exactly on the shingle sets. Texts without shingles are in neither.
    """

    def __init__(self, texts: DataFrame, row_id: str, text: str, shingle_words: int, threshold: tuple[int, int]):
        rows = written(sign(texts, row_id, text, shingle_words), "signed")
        keyed = written(rows.select("id", "set_key"), "keyed")
        known = keyed.where("set_key is not null")
        self.bare = keyed.where("set_key is null").select("id")
        classes = known.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        self.classes = written(classes, "classes")
        self.total = known.count()
        self.members = join_keyed(known, self.classes, "set_key", "n", self.total).select("id", "rep", "n")
        copies = self.members.where("id <> rep").select("id")
        if copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            sets = rows.where("set_key is not null").join(F.broadcast(copies), "id", "left_anti")
            stored = rows
        else:
            # many copies: the sets without them are worth a table of their own
            stored = sets = written(rows.where("set_key is not null").join(copies, "id", "left_anti"), "sets")
            discard(rows)
        pairs = candidates(sets, threshold)
        near = F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS else pairs
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
        common = F.size(F.array_intersect("left", "right"))
        judged = left.join(near, "a").join(right, "b").withColumn("common", common)
        judged = judged.withColumn("both", F.size("left") + F.size("right") - F.col("common"))
        top, bottom = threshold
        self.links = written(judged.where(F.col("common") * bottom >= F.col("both") * top).select("a", "b", "common", "both"), "links")
        discard(stored, pairs)

    def pairs(self) -> DataFrame:
        """Every pair of rows, a < b, whose similarity reaches the threshold: the links between
        the members of two classes and those inside one. As long as the result asks."""
        known = self.members.select("id", "rep")
        first = known.select(F.col("id").alias("x"), F.col("rep").alias("a"))
        second = known.select(F.col("id").alias("y"), F.col("rep").alias("b"))
        across = self.links.select("a", "b").join(first, "a").join(second, "b").select("x", "y")
        repeated = self.members.where("n > 1")
        inside = repeated.select(F.col("id").alias("x"), "rep").join(repeated.select(F.col("id").alias("y"), "rep"), "rep").where("x < y").select("x", "y")
        return across.unionByName(inside).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def groups(self) -> DataFrame:
        """One row for each text: id, rep, group_id (the smallest id that links lead to),
        n_copies of its class and n_links of its representative. A text without shingles stands
        alone."""
        roots = components(self.links.select("a", "b"))
        ends = self.links.select(F.col("a").alias("rep")).unionByName(self.links.select(F.col("b").alias("rep")))
        degree = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
        named = self.classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
        named = named.select("set_key", "rep", "n", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        # members has rep and n; what a representative has is joined again the balanced way
        found = join_keyed(self.members.select("id", "rep"), named.drop("set_key"), "rep", "n", self.total)
        found = found.select("id", "rep", "group_id", F.col("n").alias("n_copies"), "n_links")
        alone = self.bare.select("id", F.col("id").alias("rep"), F.col("id").alias("group_id"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links"))
        return found.unionByName(alone)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) of every node with a link.

    Rounds of large star and small star: each node hands its smallest neighbour to the others
    until all point to the root. A round is written to the shared folder; nothing but counts
    comes to the driver. Hubs are joined the balanced way.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            around = edges.select(F.col("u").alias("k"), F.col("v").alias("w")).unionByName(edges.select(F.col("v").alias("k"), F.col("u").alias("w")))
        else:
            around = edges.select(F.greatest("u", "v").alias("k"), F.least("u", "v").alias("w"))
        least = kept(around.groupBy("k").agg(F.min("w").alias("m"), F.count("*").alias("n")), "least")
        least = least.withColumn("m", F.least("m", "k"))
        total = least.agg(F.sum("n")).collect()[0][0] or 0
        joined = join_keyed(around, least, "k", "n", total)
        if large:
            made = joined.where("w > k").select(F.col("w").alias("u"), F.col("m").alias("v"))
        else:
            made = joined.select(F.col("w").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        return made.where("u <> v").distinct()

    tables: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        tables.append(written(df, name))
        return tables[-1]

    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        edges = kept(star(star(edges, True), False), "edges")
        discard(*tables[:-1])
        del tables[:-1]
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
