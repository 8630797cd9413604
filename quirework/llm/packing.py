"""Texts packed into containers of fixed capacity: bounded-space online packing.

Each partition keeps a fixed number of open windows. A text goes to the open window it fits
best; when it fits in none and no more may be opened, the fullest is emitted. The windows left
open at the end are few a partition; they are merged with those of other partitions. Only a
text that alone is larger than a container is split.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import tokenizer_dir, written

CAPACITY = 2048
OPEN_WINDOWS = 64
#: A window of so many texts (of few or no tokens) is emitted, so what a task holds is bounded.
MOST_PARTS = 10_000
#: Windows merged by one task.
MERGED_WINDOWS = 20_000

# Fixed value: the split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII text.
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")


class TokenCounter:
    """Tokens of a text by a public byte-level vocabulary, given as a file of ranks."""

    def __init__(self, file: str):
        import tiktoken

        with open(file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines)}
        self.encoding = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not text.isascii():
            return len(self.encoding.encode_ordinary(text))
        # pieces are encoded one by one anyway, so the count of each is kept
        pieces = ASCII_SPLIT.findall(text)
        try:
            return sum(map(self.known.__getitem__, pieces))
        except KeyError:
            if len(self.known) > 500_000:
                self.known.clear()
            for piece in pieces:
                if piece not in self.known:
                    self.known[piece] = len(self.encoding.encode_ordinary(piece))
            return sum(map(self.known.__getitem__, pieces))


class Windows:
    """The open windows of one partition."""

    def __init__(self, capacity: int, most_open: int, first_id: int):
        self.capacity, self.most_open, self.next_id = capacity, most_open, first_id
        #: (free room, window id), sorted
        self.free: list[tuple[int, int]] = []
        self.parts: dict[int, list[tuple]] = {}

    def place(self, part: tuple, size: int) -> Iterator[tuple[int, list[tuple]]]:
        """Puts a part of at most the capacity into a window; yields the window this closes."""
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.most_open:
                _, fullest = self.free.pop(0)
                yield fullest, self.parts.pop(fullest)
            room, window = self.capacity, self.next_id
            self.next_id += 1
            self.parts[window] = []
        self.parts[window].append(part)
        if room == size and size or len(self.parts[window]) >= MOST_PARTS:
            yield window, self.parts.pop(window)
        else:
            bisect.insort(self.free, (room - size, window))

    def left(self) -> Iterator[tuple[int, list[tuple]]]:
        yield from self.parts.items()


PLACED = "id bigint, part_no int, start_token bigint, n_tokens int, window bigint, is_open boolean"
_COLUMNS = ["id", "part_no", "start_token", "n_tokens", "window", "is_open"]


def _pack(file: str, capacity: int, most_open: int):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = TokenCounter(file)
        windows = Windows(capacity, most_open, TaskContext.get().partitionId() << 36)
        for frame in frames:
            out = []
            for row, text in zip(frame["id"].tolist(), frame["text"].tolist()):
                n = count(text)
                whole, rest = divmod(n, capacity) if n > capacity else (0, n)
                for part in range(whole):
                    out.append((row, part, part * capacity, capacity, windows.next_id, False))
                    windows.next_id += 1
                if rest or not whole:
                    for window, parts in windows.place((row, whole, whole * capacity, rest), rest):
                        out += [(*p, window, False) for p in parts]
            yield pd.DataFrame(out, columns=_COLUMNS)
        yield pd.DataFrame([(*p, window, True) for window, parts in windows.left() for p in parts], columns=_COLUMNS)

    return task


def _merge(capacity: int):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = [w for f in frames for w in zip(f["used"].tolist(), f["window"].tolist())]
        bins: list[tuple[int, int]] = []
        out = []
        for used, window in sorted(windows, reverse=True):
            at = bisect.bisect_left(bins, (used, -1))
            room, container = bins.pop(at) if at < len(bins) else (capacity, window)
            bisect.insort(bins, (room - used, container))
            out.append((window, container))
        yield pd.DataFrame(out, columns=["window", "container_id"])

    return task


def pack(texts: DataFrame, row_id: str, text: str, capacity: int = CAPACITY, tokenizer: str | None = None, most_open: int = OPEN_WINDOWS) -> DataFrame:
    """Each text's place: row_id, part_no, start_token, n_tokens and container_id.

    A text of at most the capacity is one part; a larger one is cut into full containers and a
    rest that is packed like a text. Null and empty texts have no tokens and go along in any
    container. Repeated rows are packed each; an empty table gives none. tokenizer is the path of
    a file of ranks. The texts are read once and not moved; only the parts in windows left open
    (at most most_open a partition) are.
    """
    file = tokenizer or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"
    rows = texts.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    placed = written(rows.mapInPandas(_pack(file, capacity, most_open), PLACED), "placed")
    left = placed.where("is_open")
    sizes = written(left.groupBy("window").agg(F.sum("n_tokens").alias("used")), "left-open")
    n_tasks = -(-sizes.count() // MERGED_WINDOWS) or 1
    merged = sizes.repartition(n_tasks, "window").mapInPandas(_merge(capacity), "window bigint, container_id bigint")
    closed = placed.where("not is_open").withColumn("container_id", F.col("window"))
    columns = [F.col("id").alias(row_id), "part_no", "start_token", "n_tokens", "container_id"]
    return closed.select(*columns).unionByName(left.join(merged, "window").select(*columns))


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container_id, n_parts, used_tokens and free_tokens of every container."""
    used = packed.groupBy("container_id").agg(F.count("*").alias("n_parts"), F.sum("n_tokens").alias("used_tokens"))
    return used.withColumn("free_tokens", F.lit(capacity) - F.col("used_tokens"))
