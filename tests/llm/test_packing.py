import os
import random

import pytest

from quirework.llm.packing import TokenCounter, Windows, containers, pack
from quirework.session import tokenizer_dir

FILE = f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"
needs_file = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer files")


def test_windows_never_overflow_and_stay_few():
    r = random.Random(5)
    windows, closed, sizes = Windows(100, 8, 0), [], {}
    for k in range(3000):
        sizes[k] = r.choice([0, 1, 7, 33, 50, 60, 99, 100, r.randrange(101)])
        closed += list(windows.place((k,), sizes[k]))
        assert len(windows.free) <= 8
    closed += list(windows.left())
    placed = [k for _, parts in closed for (k,) in parts]
    assert sorted(placed) == list(range(3000))
    used = [sum(sizes[k] for (k,) in parts) for _, parts in closed]
    assert max(used) <= 100 and sum(used) / (100 * len(used)) > 0.95


@needs_file
def test_counts_are_the_encodings():
    count = TokenCounter(FILE)
    for text in ["", "Don't stop  now\n\n", "it’s naïve", "x" * 5000, "a b  c   \t d", "1990s' 'll", "\x1c\x85 y"]:
        assert count(text) == len(count.encoding.encode_ordinary(text))
    assert count(None) == 0


@needs_file
def test_pack(spark):
    r = random.Random(6)
    texts = [(i, "word " * r.randrange(150), 0) for i in range(400)] + [(900, "long " * 1000, 0), (901, None, 0), (902, "", 0), (903, "", 0)] + [(904, "same text", 0)] * 3
    frame = spark.createDataFrame(texts, "id long, body string, container_id int").repartition(3)
    placed = pack(frame, "id", "body", capacity=128).cache()
    rows = placed.collect()
    assert len({x.id for x in rows}) == 405 and sum(x.id == 904 for x in rows) == 3
    by = {}
    for x in rows:
        by.setdefault(x.id, []).append(x)
    assert all(len(v) == 1 for k, v in by.items() if k != 904 and sum(p.n_tokens for p in v) <= 128)
    long = sorted(by[900], key=lambda x: x.part_no)
    assert [x.start_token for x in long] == [128 * k for k in range(len(long))] and all(x.n_tokens == 128 for x in long[:-1])
    full = containers(placed, 128).collect()
    assert all(c.free_tokens >= 0 for c in full) and sum(c.used_tokens for c in full) == sum(x.n_tokens for x in rows)
    assert sum(c.used_tokens for c in full) / (128 * len(full)) > 0.95
    assert pack(frame.where("false"), "id", "body").count() == 0
