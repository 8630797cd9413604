"""Evaluation texts that leak into a corpus: a broadcast set of hashed n-grams of the test items,
looked up in every word window of every document, each hit verified word by word.

The set is broadcast in blocks whose n-grams have a fixed bound together, each block against all
documents; a normal suite is one block. What the blocks find is put together by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.words import WORD, window_hashes, words
from quirework.session import written

#: Consecutive words in common that make a leak.
WINDOW = 12
#: N-grams of one broadcast block: about 100 MB in each Python worker at most.
BLOCK_WINDOWS = 1_000_000
#: Leaking documents whose word positions are broadcast; more are joined by a shuffle.
BROADCAST_DOCUMENTS = 20_000


class Block:
    """The items of one block, ready for lookup. A word of the items is a number; others are 0,
    and no window that holds one can match."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        self.numbers: dict[str, int] = {}
        listed = []
        for item, text in items:
            found = words(text)
            numbered = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in found], np.uint64)
            if len(numbered) >= window:
                listed.append((item, numbered))
        self.items = listed
        hashes = [window_hashes(n, window) for _, n in listed]
        sizes = [len(h) for h in hashes]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        of_item = np.repeat(np.arange(len(listed)), sizes)
        offset = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.of_item, self.offset = flat[order], of_item[order], offset[order]

    def hits(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """Of many texts: (text number, item number, word offset) of every window in common."""
        found = [words(t) for t in texts]
        get, size = self.numbers.get, self.window
        # texts are laid end to end, with a number that matches nothing between them
        flat = np.fromiter((get(w, 0) for ws in found for w in (*ws, "")), np.uint64)
        if len(flat) < size or not len(self.hashes):
            return
        known = np.concatenate([[0], np.cumsum(flat != 0)])
        whole = np.flatnonzero(known[size:] - known[:-size] == size)
        if not len(whole):
            return
        hashed = np.zeros(len(whole), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + flat[whole + k]
                hashed ^= hashed >> np.uint64(29)
        first = np.searchsorted(self.hashes, hashed, "left")
        last = np.searchsorted(self.hashes, hashed, "right")
        starts = np.cumsum([0] + [len(ws) + 1 for ws in found])
        for k in np.flatnonzero(last > first):
            at = whole[k]
            text = int(np.searchsorted(starts, at, "right")) - 1
            for e in range(first[k], last[k]):
                item, offset = int(self.of_item[e]), int(self.offset[e])
                if np.array_equal(flat[at : at + size], self.items[item][1][offset : offset + size]):
                    yield text, item, int(at - starts[text])


def blocks(items: DataFrame, item_id: str, text: str, window: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of at most BLOCK_WINDOWS n-grams. An item that alone has more comes
    in pieces that overlap by less than a window, so each of its n-grams is in one piece. Items
    come to the driver one partition at a time."""
    held, size = [], 0
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")).where("t is not null and i is not null")
    for row in rows.toLocalIterator():
        pieces = [row["t"]]
        if len(row["t"]) // 2 + 1 > BLOCK_WINDOWS:
            found = words(row["t"])
            pieces = [" ".join(found[k : k + BLOCK_WINDOWS + window - 1]) for k in range(0, max(len(found) - window + 1, 1), BLOCK_WINDOWS)]
        for piece in pieces:
            n = min(len(piece) // 2 + 1, BLOCK_WINDOWS)
            if held and size + n > BLOCK_WINDOWS:
                yield held
                held, size = [], 0
            held.append((row["i"], piece))
            size += n
    if held:
        yield held


def _scan(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int, schema: str, make: Callable) -> tuple[DataFrame, int]:
    """What `make` finds in each frame of documents (id, text, text_key) with each block, and the
    number of blocks."""
    spark = documents.sparkSession
    rows = keyed(documents, doc_id, text).where("text is not null")
    whole, n = spark.createDataFrame([], schema), 0
    for held in blocks(items, item_id, item_text, window):
        sent = spark.sparkContext.broadcast((held, window))

        def search(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            block = Block(*sent.value)
            for frame in frames:
                yield make(block, frame)

        part = rows.mapInPandas(search, schema)
        whole, n = part if not n else whole.unionByName(part), n + 1
    return whole, n


def keyed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, text and text_key, by which two texts that come with one id are told apart."""
    return documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))


def leaks(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id and n_windows for every document and test item that have `window`
    consecutive words in common.

    Items under `window` words, and null texts of either side, match nothing. Repeated documents
    or items each give their own rows (where the items fill several blocks, rows that are wholly
    equal count together); no documents or no items give none. One pass over the corpus for each
    block of items; no shuffle of texts.
    """

    def make(block: Block, frame: pd.DataFrame) -> pd.DataFrame:
        counted: dict[tuple[int, int], int] = {}
        for row, item, _ in block.hits(frame["text"].tolist()):
            counted[row, item] = counted.get((row, item), 0) + 1
        ids, keys = frame["id"].tolist(), frame["text_key"].tolist()
        return pd.DataFrame([(ids[r], keys[r], block.items[i][0], n) for (r, i), n in counted.items()], columns=["id", "text_key", "item_id", "n_windows"])

    found, n = _scan(documents, items, doc_id, text, item_id, item_text, window, "id bigint, text_key bigint, item_id bigint, n_windows bigint", make)
    if n > 1:
        found = found.groupBy("id", "text_key", "item_id").agg(F.sum("n_windows").alias("n_windows"))
    return found.select(F.col("id").alias(doc_id), F.col("item_id").alias(item_id), "n_windows")


def without_leaks(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """The documents with leaks, a row each: doc_id, n_removed (words of leaked spans) and cleaned,
    the text without those spans, whichever blocks of items they come from.

    The blocks give word positions only, put together by document; the texts of leaking documents
    are then read again and cut once.
    """

    def make(block: Block, frame: pd.DataFrame) -> pd.DataFrame:
        starts = {(row, at) for row, _, at in block.hits(frame["text"].tolist())}
        ids, keys = frame["id"].tolist(), frame["text_key"].tolist()
        return pd.DataFrame([(ids[r], keys[r], at) for r, at in starts], columns=["id", "text_key", "at"])

    found, _ = _scan(documents, items, doc_id, text, item_id, item_text, window, "id bigint, text_key bigint, at bigint", make)
    # a document has at most as many starts as words
    starts = written(found.groupBy("id", "text_key").agg(F.collect_set("at").alias("starts")), "leaked-spans")
    near = F.broadcast(starts) if starts.count() <= BROADCAST_DOCUMENTS else starts
    cut = F.pandas_udf(lambda texts, at: pd.DataFrame([without_windows(t, a, window) for t, a in zip(texts, at)], columns=["n_removed", "cleaned"]), "n_removed bigint, cleaned string")
    both = keyed(documents, doc_id, text).join(near, ["id", "text_key"]).withColumn("made", cut("text", "starts"))
    return both.select(F.col("id").alias(doc_id), "made.n_removed", "made.cleaned")


def without_windows(text: str, starts: Iterable[int], window: int) -> tuple[int, str]:
    """How many words the windows that begin at these words cover, and the text without them."""
    taken = {k for at in starts for k in range(at, at + window)}
    lower = text.lower()
    # where lower-casing changes a text's length, its lower case is what is cut
    base = text if len(lower) == len(text) else lower
    places = [m.span() for m in WORD.finditer(lower)]
    kept, at = [], 0
    for k in sorted(taken):
        if k - 1 not in taken:
            kept.append(base[at : places[k][0]])
        at = places[k][1]
    return len(taken), "".join([*kept, base[at:]])
