"""Text from scanned pages, repaired into readable paragraphs.

Lines are labelled as furniture (running head or foot, page number), body or break by a linear
conditional model on layout features (line_model), fitted on the data and decoded along each
page. Body lines are reassembled; a word split at a line end is joined where the corpus knows the
whole word rather than the compound; a misread word becomes the corpus word that usual confusions
of characters explain. Word counts are taken over all texts of all tables.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm import line_model as M
from quirework.session import discard, written

# Confusions of scanning, as seen and as meant.
CONFUSED = (
    ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("ri", "n"), ("c", "e"), ("f", "t"),
    ("0", "o"), ("1", "l"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("!", "i"), ("@", "a"),
)
#: Hyphens at a line's end: these may belong to the word, those never do.
HYPHENS, BREAKS = "-‐‑", "¬\xad"
#: Lines of one page handled together; a longer page is cut in reading order.
PAGE_LINES = 2000
#: A word in usual letters is a misreading of another one if, as sure as two standard errors make
#: it, no more than this share of both is read so: names are met often, a misreading isn't.
MOST_MISREAD = 0.03
#: Rows of a table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000

# Possessive, so that no text makes the engine recurse.
_WORD = r"[@!]?[\p{L}\p{N}]++(?:[@!][\p{L}\p{N}]++)*+@?"
_COMPOUND = r"(\p{L}++-\p{L}++)"
_ENDING = rf"({_WORD})([{HYPHENS}{BREAKS}])\s*$"
_BEGINNING = rf"^\s*({_WORD})"
_HYPHENED = rf"[{HYPHENS}{BREAKS}](?:[ \t]*\n|[ ])"
SPLITS = "array<struct<first: string, mark: string, second: string>>"
_SPLIT = rf"({_WORD})([{HYPHENS}{BREAKS}])(?:[ \t]*\n\s*|[ ]+)(?=[^\p{{L}}]|\p{{Ll}})({_WORD})"

WORD = re.compile(r"[@!]?[^\W_]++(?:[@!][^\W_]++)*+@?")
_ENDS = re.compile(rf"({WORD.pattern})([{HYPHENS}{BREAKS}])\s*\Z")
_BEGINS = re.compile(rf"\s*({WORD.pattern})")
_INNER = re.compile(rf"({WORD.pattern})([{HYPHENS}{BREAKS}])([ \t]*\n\s*|[ ]+)({WORD.pattern})")


def small(df: DataFrame) -> DataFrame:
    """A table for the other side of a join: broadcast only where it was counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def mask(text: Column) -> Column:
    """A line's text with numbers masked and confused letters folded, for counting running heads."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"(?<![a-z@!])[0-9]+(?![a-z@!])", "#")
    plain = F.regexp_replace(plain, r"^\W*[ivxlcdm]+(?=\W{2,})|(?<=\W{2})[ivxlcdm]+\W*$|^\W*[ivxlcdm]+\W*$", "#")
    plain = F.translate(plain, "!i10568@9cf", "lllosbbaget")
    for seen, meant in (("rn", "m"), ("vv", "w"), ("el", "d"), ("ll", "u"), ("lu", "h"), ("rl", "n")):
        plain = F.replace(plain, F.lit(seen), F.lit(meant))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}#]+", " "))


# ---- labelling ---------------------------------------------------------------------------------

PAGE = ("doc", "page", "chunk")
#: Looks that a line has by itself and with its neighbours; the two about words come later.
OWN_LOOKS = tuple(name for name in M.LOOKS if not name.endswith("_words"))
#: Features that are true or false, by their bit in a line's code.
BITS = {name: k for k, name in enumerate((*OWN_LOOKS, *M.PLACES))}
ODDS_STEPS = 16


def chunked(lines: DataFrame) -> DataFrame:
    """line_id, doc, page, chunk, last_chunk of its page, col_no, line_no and text. chunk is 0 but on pages of more than PAGE_LINES lines, which are cut in reading order after a
    sort by ranges; so neither a huge page nor all lines without a page are one task's."""
    rows = lines.select("line_id", F.coalesce("doc", F.lit("")).alias("doc"), F.coalesce("page", F.lit(0)).alias("page"), "col_no", "line_no", "text")
    huge = written(rows.groupBy("doc", "page").count().where(F.col("count") > PAGE_LINES).select("doc", "page"), "huge-pages")
    if not huge.limit(1).count():
        return rows.withColumns({"chunk": F.lit(0), "last_chunk": F.lit(0)})
    kept = rows.join(small(huge), ["doc", "page"], "left_anti").withColumns({"chunk": F.lit(0), "last_chunk": F.lit(0)})
    cut = rows.join(small(huge), ["doc", "page"], "left_semi")
    order = ["doc", "page", "col_no", "line_no", "line_id"]
    cut = cut.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # a partition's rows are numbered from a multiple of 2^33
    cut = written(cut.withColumn("_piece", F.floor(F.col("_at") / PAGE_LINES)).drop("_at"), "cut-pages")
    # one row a piece, so a page's pieces are few
    pieces = cut.select("doc", "page", "_piece").distinct()
    of_page = Window.partitionBy("doc", "page")
    pieces = pieces.withColumn("chunk", F.row_number().over(of_page.orderBy("_piece")) - 1).withColumn("last_chunk", F.max("chunk").over(of_page))
    return kept.unionByName(cut.join(small(written(pieces, "pieces")), ["doc", "page", "_piece"]).drop("_piece"))


def looks(text: Column, before: Column, after: Column) -> dict[str, Column]:
    """How a line looks, by itself and between the texts before and after it."""
    line = F.trim(text)
    words, chars = F.size(F.split(line, r"\s+")), F.length(line)
    number = line.rlike(M.NUMBER_LINE) & (line.rlike("[0-9]") | (F.lower(line) == line))
    titled = ~line.rlike(M.NOT_TITLED)
    ended = F.substring(F.rtrim(before), -1, 1)
    return {
        "number": F.when(chars <= 40, number).otherwise(False),
        # only a bracket, a bar or a gap can set a number apart
        "numbered": F.when((words <= 8) & line.rlike(r"^\[|\||\s\s"), line.rlike(M.NUMBERED)).otherwise(False),
        "titled": titled, "capital": ~titled & line.rlike(r"^\p{Lu}"), "upper": (F.upper(line) == line) & (F.lower(line) != line),
        "words_3": words <= 3, "words_6": (words > 3) & (words <= 6), "words_9": words > 8, "chars_25": chars <= 25, "chars_40": (chars > 25) & (chars <= 40),
        "punctuation": line.rlike(M.ENDS_SENTENCE) & ~line.rlike(M.BEFORE_LAST_DIGIT), "hyphen": line.rlike(M.ENDS_HYPHEN), "lower": line.rlike(M.STARTS_LOWER),
        "interrupts": F.coalesce(~ended.isin(*".!?:") & F.ltrim(after).rlike(r"^\p{Ll}"), F.lit(False)), "indent": text.rlike(r"^\s\s"),
    }


def described(lines: DataFrame) -> DataFrame:
    """line_id, doc, page, chunk, at (the line's number in its chunk), text, masked, looks and places
    (arrays, by OWN_LOOKS and the first of PLACES); lines without text have null masks."""
    rows = chunked(lines)
    order = Window.partitionBy(*PAGE).orderBy("col_no", "line_no", "line_id")
    full = F.coalesce(F.length(F.trim("text")) > 0, F.lit(False))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("full", full)
    own = Window.partitionBy(*PAGE, "full").orderBy("at")
    before, after = F.lag("text").over(own), F.lead("text").over(own)
    k = F.row_number().over(own)
    n = F.count("*").over(Window.partitionBy(*PAGE, "full"))
    near = rows.withColumns({
        "_before": before, "_after": after, "_k": k, "_n": n, "_gap_before": F.coalesce(F.lag("at").over(own), F.lit(0)) < F.col("at") - 1,
        "_gap_after": F.lead("at").over(own) > F.col("at") + 1,
        "_edge": ~F.coalesce(F.lag("col_no").over(own).eqNullSafe(F.col("col_no")) & F.lead("col_no").over(own).eqNullSafe(F.col("col_no")), F.lit(False)),
    })
    first, final = F.col("chunk") == 0, F.col("chunk") == F.col("last_chunk")
    top, bottom = first & (F.col("_k") == 1), final & (F.col("_k") == F.col("_n"))
    cut = (~first & (F.col("_k") == 1)) | (~final & (F.col("_k") == F.col("_n")))
    place = {"top": top, "bottom": bottom, "edge": top | bottom | (F.col("_edge") & ~cut), "near_edge": (first & (F.col("_k") <= 2)) | (final & (F.col("_k") >= F.col("_n") - 1))}
    seen = looks(F.col("text"), F.col("_before"), F.col("_after")) | {"gap_before": F.col("_gap_before"), "gap_after": F.coalesce("_gap_after", F.lit(False))}
    as_bits = lambda columns: F.array(*(c.cast("tinyint") for c in columns))
    return near.select(
        "line_id", *PAGE, "at", "text", F.when(F.col("full"), mask(F.col("text"))).alias("masked"),
        F.when(F.col("full"), as_bits(seen[name] for name in OWN_LOOKS)).alias("looks"), F.when(F.col("full"), as_bits(place.values())).alias("places"),
    )


def recurring(lines: DataFrame) -> DataFrame:
    """line_id, in_document and in_corpus of the lines whose masked text stands at a page's edge more
    than once: whether it does elsewhere in the line's document (and in the corpus more often than
    inside pages), and whether mostly so in the corpus.
    Heads of any length count; page numbers alone (masked as #) tell nothing here."""
    near = F.col("places")[3] == 1
    named = lines.where("masked is not null and masked not in ('', '#')").select("line_id", "doc", "masked", near.alias("near"))
    in_doc = written(named.where("near").groupBy("doc", "masked").agg(F.count("*").alias("n_doc")), "document-heads")
    heads = in_doc.groupBy("masked").agg(F.sum("n_doc").alias("n_edges")).where("n_edges > 1")
    hits = written(named.join(small(written(heads, "heads")), "masked"), "head-lines")
    inside = hits.where("not near").groupBy("masked").agg(F.count("*").alias("n_inside"))
    known = hits.join(small(inside), "masked", "left").join(small(in_doc.where("n_doc > 0")), ["doc", "masked"], "left").fillna(0, ["n_inside", "n_doc"])
    elsewhere = (F.col("n_doc") > F.col("near").cast("int")) & (F.col("n_edges") > F.col("n_inside"))
    mostly = (F.col("n_edges") - F.col("near").cast("int") > 2) & (F.col("n_edges") > 2 * F.col("n_inside"))
    return written(known.select("line_id", elsewhere.alias("in_document"), mostly.alias("in_corpus")), "recurring")


def head_words(lines: DataFrame) -> DataFrame:
    """line_id and odds: for short lines, the largest log odds among their words of standing in heads
    that come back (documents, without the line's own) against lines inside pages. lines has
    in_document and in_corpus. Odds are cut at 3 either way and rounded to ODDS_STEPS a unit, so
    that lines can be counted by them."""
    near, number = F.col("places")[3] == 1, F.col("looks")[OWN_LOOKS.index("number")] == 1
    known = F.col("in_document") | F.col("in_corpus")
    words = F.array_distinct(F.filter(F.split("masked", " "), lambda w: (F.length(w) > 1) & (w != "#")))
    full = lines.where(F.col("masked").isNotNull() & ~number).select("line_id", "doc", "in_document", known.alias("known"), near.alias("near"), words.alias("words"))
    asked = full.where(F.size("words") <= 8).select("line_id", "doc", (F.col("in_document") & F.col("near")).alias("own"), F.explode("words").alias("word"))
    asked = written(asked, "head-words")
    by_doc = asked.where("own").select("doc", "word").distinct()
    heads = by_doc.groupBy("word").agg(F.count("*").alias("n_head"))
    wanted = asked.select("word").distinct()
    body = full.where("not near and not known").select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n_body"))
    stats = wanted.join(heads, "word", "left").join(body, "word", "left").fillna(0)
    found = asked.join(small(written(stats, "head-odds")), "word").join(small(written(by_doc.withColumn("counted", F.lit(1)), "own-heads")), ["doc", "word"], "left")
    others = F.col("n_head") - F.when(F.col("own"), F.coalesce("counted", F.lit(0))).otherwise(0)
    odds = F.log((others + 0.5) / (F.col("n_body") + 0.5))
    largest = F.greatest(F.least(F.max(odds), F.lit(3.0)), F.lit(-3.0))
    return found.groupBy("line_id").agg((F.round(largest * ODDS_STEPS) / ODDS_STEPS).alias("odds"))


LABELLED = "line_id bigint, doc string, page int, chunk int, at int, text string, label string, opens boolean, ended boolean, begins string, second string, next_id bigint, is_first boolean, is_last boolean"


def _label(beside: float):
    """Scored lines, sorted by page, to labelled ones. A batch may hold many pages; a page (at most
    PAGE_LINES lines) is held until it is whole."""

    def whole(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        scores = table["score"].to_numpy(zero_copy_only=False).astype(float)
        full = ~np.isnan(scores)
        pages = np.r_[0, np.flatnonzero(table["starts"].to_numpy(zero_copy_only=False)[1:]) + 1, n]
        furniture = np.zeros(n, bool)
        for a, b in zip(pages[:-1], pages[1:]):
            lines = a + np.flatnonzero(full[a:b])
            furniture[lines] = M.decode(scores[lines].tolist(), beside)
        body = np.flatnonzero(full & ~furniture)
        page_of = np.repeat(np.arange(len(pages) - 1), np.diff(pages))[body]
        ended = table["ended"].to_numpy(zero_copy_only=False).astype(bool)
        same = np.r_[False, page_of[1:] == page_of[:-1]] if len(body) else np.empty(0, bool)
        follows = np.r_[same[1:], False] if len(body) else same
        opens, first, last = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        first[body], last[body] = ~same, ~follows
        before = np.r_[0, body[:-1]] if len(body) else body
        opens[body] = ~same | ended[before]
        following = np.full(n, -1)
        following[body[follows]] = np.r_[body[1:], -1][follows] if len(body) else body
        index = pa.array(following, mask=following < 0)
        label = np.where(~full, "break", np.where(furniture, "furniture", "body"))
        columns = {
            "opens": pa.array(opens), "label": pa.array(label), "second": pc_take(table["begins"], index), "next_id": pc_take(table["line_id"], index),
            "is_first": pa.array(first), "is_last": pa.array(last),
        }
        names = [c.split()[0] for c in LABELLED.split(", ")]
        return pa.table({name: columns[name] if name in columns else table[name] for name in names}).combine_chunks().to_batches()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            starts = np.flatnonzero(held["starts"].to_numpy(zero_copy_only=False))
            if len(starts) > 1:
                yield from whole(held.slice(0, starts[-1]))
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from whole(held)

    return task


def pc_take(column: pa.ChunkedArray, index: pa.Array) -> pa.Array:
    return column.combine_chunks().take(index)


def _score(weights: dict[str, float]) -> Column:
    """A line's weight for furniture, from code and odds; without what stands beside it."""
    score = F.lit(weights["bias"])
    for name, k in BITS.items():
        if name in weights:
            score = score + F.getbit("code", F.lit(k)).cast("double") * weights[name]
    return score + F.greatest("odds", F.lit(0.0)) * weights["head_words"] + F.least("odds", F.lit(0.0)) * weights["body_words"]


def fitted(lines: DataFrame) -> dict[str, float]:
    """The weights of the line model as M.fit_lines has them, fitted on all lines. lines has PAGE,
    at, code (null without text) and odds.

    Lines are counted by code, odds and furniture beside them, and only these counts come to
    the driver: their number is bounded by the features, not by the lines.
    """

    def counted(rows: DataFrame, *more: str) -> tuple[np.ndarray, ...]:
        columns = ["code", "odds", *more]
        met = rows.groupBy(*columns).agg(F.count("*").alias("n")).toPandas().sort_values(columns)
        bits = (met["code"].to_numpy(np.int64)[:, None] >> np.arange(len(BITS))) & 1
        odds = met["odds"].to_numpy(float)[:, None]
        looks = np.hstack([bits[:, : len(OWN_LOOKS)], np.maximum(odds, 0), np.minimum(odds, 0)]).astype(float)
        return looks, bits[:, len(OWN_LOOKS) :].astype(float), met["n"].to_numpy(float), *(met[c].to_numpy(float) for c in more)

    def beside(score: Column) -> Column:
        """How many of the two lines around a line are furniture, as M.targets has it."""
        bit = lambda name: F.getbit("code", F.lit(BITS[name])) == 1
        edge, back = bit("edge") | bit("near_edge"), bit("in_document")
        on = F.when(edge & (back | bit("number")), 1).when(~edge & ~back & ~bit("in_corpus"), 0).otherwise((score > 0).cast("int"))
        near = Window.partitionBy(*PAGE).orderBy("at")
        return F.coalesce(F.lag(on).over(near), F.lit(0)) + F.coalesce(F.lead(on).over(near), F.lit(0))

    full = lines.where("code is not null").select(*PAGE, "at", "code", "odds")
    looks, places, n = counted(full)
    first = M.fit_looks(looks, places, n)
    shape = dict(zip(M.NAMES, first.tolist()))
    once = written(full.withColumn("beside", beside(_score(shape))), "beside-lines")
    looks, places, n, near = counted(once, "beside")
    x = M.features(looks, places, near)
    weights = M.fit(x, M.targets(looks, places, M.sigmoid(M.shape_of(looks) @ first)), M.PRIOR, n=n)
    named = dict(zip(M.NAMES, weights.tolist()))
    looks, places, n, near, again = counted(once.withColumn("again", beside(_score(named) + F.col("beside") * named["beside"])), "beside", "again")
    likely = M.sigmoid(M.features(looks, places, near) @ weights)
    weights = M.fit(M.features(looks, places, again), M.targets(looks, places, likely), M.PRIOR, n=n)
    discard(once)
    return dict(zip(M.NAMES, weights.tolist()))


def labelled_lines(lines: DataFrame) -> DataFrame:
    """The lines with their label and, for body lines, what splits at their ends need: whether the
    first word may be a split's second half, whether the line ends in a split, its first word, and
    the next body line's first word and id.

    Lines without text are breaks. Pages may be stored in any order; a page is read by column
    and line number (ties by id), null numbers first. The counts of running heads and of their
    words, the odds and the weights are all taken over all lines, however many there are.
    """
    kept = written(described(lines), "page-lines")
    facts = recurring(kept)
    seen = kept.join(small(facts), "line_id", "left").fillna(False, ["in_document", "in_corpus"])
    odds = written(head_words(seen), "line-odds")
    bits = [*(F.col("looks")[k] for k in range(len(OWN_LOOKS))), *(F.col("places")[k] for k in range(4)), F.col("in_document"), F.col("in_corpus")]
    code = reduce(add, (b.cast("int") * 2**k for k, b in enumerate(bits)))
    known = seen.join(small(odds), "line_id", "left").select("line_id", *PAGE, "at", "text", code.alias("code"), F.coalesce("odds", F.lit(0.0)).alias("odds"))
    known = written(known, "line-facts")
    discard(kept, facts, odds)
    weights = fitted(known)
    begins = F.nullif(F.regexp_extract("text", _BEGINNING, 1), F.lit(""))
    hyphened = F.substring(F.rtrim("text", F.lit(" \t\r\n\x0b\f")), -1, 1).isin(list(HYPHENS + BREAKS))
    ready = known.select(
        "line_id", *PAGE, "at", "text", _score(weights).alias("score"), begins.alias("begins"),
        F.coalesce(F.when(hyphened, F.col("text").rlike(_ENDING)), F.lit(False)).alias("ended"), (F.col("at") == 1).alias("starts"),
    )
    ordered = ready.repartition(*PAGE).sortWithinPartitions(*PAGE, "at")
    return ordered.mapInArrow(_label(weights["beside"]), LABELLED)


# ---- texts of one field ------------------------------------------------------------------------


def without_furniture(rows: DataFrame) -> DataFrame:
    """rows with cleaned (the text without the furniture inside it) and furniture (whether there was
    any). The weights are fitted on at most SAMPLED_TEXTS texts of several lines, chosen by hash;
    texts of one line without a number beside a title don't reach Python."""
    several = rows.where(F.contains("text", F.lit("\n"))).select("text")
    every = max(math.ceil(several.count() / M.SAMPLED_TEXTS), 1)
    sampled = several.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).limit(2 * M.SAMPLED_TEXTS)
    weights = M.fit_pieces(sorted(r[0] for r in sampled.collect()))

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([clean_field(t, weights)[0] if t is not None else None for t in texts], dtype=object)

    likely = F.contains("text", F.lit("\n")) | F.when(F.col("text").rlike(M.NEAR_SPAN), F.col("text").rlike(M.SPAN))
    made = F.pandas_udf(each, "string")(F.when(likely, F.col("text")))
    return rows.withColumn("cleaned", F.coalesce(made, "text")).withColumn("furniture", F.col("cleaned") != F.col("text"))


def clean_field(text: str, weights: list[float] = M.PIECE_PRIOR) -> tuple[str, bool]:
    """The text without the furniture inside it, and whether there was any. One space stands for a
    span inside a line."""
    spans = M.furniture_spans(text, weights)
    parts, at = [], 0
    for a, b in spans:
        if text[a:b].startswith("\n") or text[a:b].endswith("\n"):
            parts.append(text[at:a])
        else:
            parts += [text[at:a].rstrip(" "), " "]
            while b < len(text) and text[b] == " ":
                b += 1
        at = b
    return "".join([*parts, text[at:]]), bool(spans)


# ---- words -------------------------------------------------------------------------------------


def words_of(text: Column) -> Column:
    """The words of a text in lower case, and its compounds as a whole besides."""
    lower = F.lower(text)
    words = F.regexp_extract_all(lower, F.lit(f"({_WORD})"), F.lit(1))
    return F.when(F.contains(lower, F.lit("-")), F.concat(words, F.regexp_extract_all(lower, F.lit(_COMPOUND), F.lit(1)))).otherwise(words)


def splits_of(text: Column) -> Column:
    """first, mark and second of every possible split inside a text."""
    pattern = F.lit(_SPLIT)
    parts = [F.regexp_extract_all(text, pattern, F.lit(k)).alias(name) for k, name in ((1, "first"), (2, "mark"), (3, "second"))]
    return F.arrays_zip(*parts)


def folded(word: Column) -> Column:
    """A key that a word and all its misreadings share: each letter as the strokes that scanning
    confuses it with, so undoing a confusion never changes the key."""
    key = F.translate(word, "cf0156889!@", "etolsbbbgia")
    for letter, strokes in (("m", "rri"), ("n", "ri"), ("w", "vv"), ("d", "el"), ("u", "ii"), ("h", "li")):
        key = F.replace(key, F.lit(letter), F.lit(strokes))
    return key


def is_confusion(word: str, meant: str) -> bool:
    """Whether usual confusions alone lead from what was meant to the word as it was read."""
    reached = {(0, 0)}
    while reached:
        if (len(word), len(meant)) in reached:
            return True
        following = set()
        for i, j in reached:
            if i < len(word) and j < len(meant):
                if word[i] == meant[j]:
                    following.add((i + 1, j + 1))
                for seen, true in _BY_TRUE.get(meant[j], ()):
                    if word.startswith(seen, i):
                        following.add((i + len(seen), j + len(true)))
        reached = following
    return False


_BY_TRUE: dict[str, list[tuple[str, str]]] = {}
for _seen, _true in CONFUSED:
    _BY_TRUE.setdefault(_true[0], []).append((_seen, _true))


def _confirmed(words: pd.Series, meant: pd.Series) -> pd.Series:
    return pd.Series([is_confusion(w, m) for w, m in zip(words, meant)], dtype=bool)


def misread_words(vocabulary: DataFrame, extra: DataFrame) -> DataFrame:
    """word and meant: the words that are misreadings of a more frequent one. vocabulary has word
    and n; extra has words (joined halves) that may be in it or not. Compounds are left out.

    A word meets the words in usual letters that have its key; confusions are then undone one by
    one, however many there are. Of several the most frequent is meant.
    """
    known = vocabulary.select("word", "n")
    types = known.unionByName(extra.select("word", F.lit(0).cast("bigint").alias("n"))).where(~F.contains("word", F.lit("-")) & (F.length("word") > 1) & F.col("word").rlike(r"\p{L}"))
    types = types.groupBy("word").agg(F.max("n").alias("n")).withColumn("key", folded(F.col("word")))
    target = known.where("n > 2 and not contains(word, '-')").where(~F.col("word").rlike("[0-9@!]"))
    target = target.select(F.col("word").alias("meant"), F.col("n").alias("n_meant"), folded(F.col("word")).alias("key"))
    both, strange = F.col("n") + F.col("n_meant"), F.col("word").rlike("[0-9@!]")
    # the lower end of Wilson's interval, at two standard errors, for the share that is misread
    share = F.col("n") / both
    spread = 2 * F.sqrt(share * (1 - share) / both + 1 / (both * both))
    lowest = (share + 2 / both - spread) / (1 + 4 / both)
    enough = F.when(strange, F.col("n_meant") > F.col("n")).otherwise((F.col("n") == 0) | ((lowest <= MOST_MISREAD) & (F.col("n_meant") >= 4 * F.col("n"))))
    best = F.max_by("meant", F.struct("n_meant", "meant")).alias("meant")
    met = types.join(target, "key").where((F.col("word") != F.col("meant")) & enough)
    return met.where(F.pandas_udf(_confirmed, "boolean")("word", "meant")).groupBy("word").agg(best)


class Repairs:
    """What is wrong with the texts of several tables, from one count of words.

    lines: page_lines with line_id, doc, page, col_no, line_no and text. fields: a list of
    (table name, field name, DataFrame of row_id and text). Null texts have no faults; empty
    tables are allowed; of a field that is an array each element is one text. Repeated rows are
    judged alike.
    """

    def __init__(self, lines: DataFrame, fields: list[tuple[str, str, DataFrame]]):
        labelled = labelled_lines(lines)
        body = F.col("label") == "body"
        inner = F.when(F.col("ended"), F.regexp_replace("text", _ENDING, "")).otherwise(F.col("text"))
        inner = F.when(F.col("opens"), F.regexp_replace(inner, _BEGINNING, "")).otherwise(inner)
        self.lines = written(labelled.withColumn("words", F.when(body, words_of(inner)).otherwise(F.array().cast("array<string>"))), "labelled")
        texts = None
        for table_name, field_name, rows in fields:
            part = rows.select(F.lit(table_name).alias("table_name"), F.lit(field_name).alias("field_name"), F.col("row_id").cast("bigint").alias("row_id"), "text")
            texts = part if texts is None else texts.unionByName(part)
        facts = without_furniture(texts.where("text is not null"))
        splits = F.when(F.col("cleaned").rlike(_HYPHENED), F.nullif(splits_of(F.col("cleaned")), F.array().cast(SPLITS)))
        both = F.filter("splits", lambda s: F.lower(s["second"]).isin("and", "or", "to") & s["mark"].isin(list(HYPHENS)))
        halves = F.flatten(F.transform(both, lambda s: F.array(F.lower(s["first"]), F.lower(s["second"]))))
        whole = F.when(F.col("splits").isNull(), F.col("cleaned")).otherwise(F.regexp_replace("cleaned", _SPLIT, " "))
        facts = facts.withColumn("splits", splits).withColumn("words", F.concat(words_of(whole), F.coalesce(halves, F.array().cast("array<string>"))))
        self.fields = written(facts, "fields")
        words = self.lines.select(F.explode("words").alias("word")).unionByName(self.fields.select(F.explode("words").alias("word")))
        self.vocabulary = written(words.groupBy("word").agg(F.count("*").alias("n")), "vocabulary")
        self.splits = written(self._splits(), "splits")
        joined = self.splits.select(F.lower(F.concat("first", "second")).alias("word"))
        self.misread = written(misread_words(self.vocabulary, joined), "misread")
        self.judged = written(self._judged(), "judged")

    def _splits(self) -> DataFrame:
        """Every possible split: where it is, both halves, the hyphen and the second half's row."""
        here = F.lit("page_lines").alias("table_name"), F.lit("text").alias("field_name")
        halves = F.regexp_extract("text", _ENDING, 1).alias("first"), F.regexp_extract("text", _ENDING, 2).alias("mark")
        ended = self.lines.where("label = 'body' and ended").select("line_id", "doc", "page", "chunk", *halves, "second", "next_id", "is_last")
        within = ended.where("next_id is not null").select(*here, F.col("line_id").alias("row_id"), "first", "mark", "second", F.col("next_id").alias("second_id"))
        over = ended.where("next_id is null and is_last").select(*here, F.col("line_id").alias("row_id"), "first", "mark", "doc", "page", "chunk")
        # one row a page, or piece of one, on either side: keys are unique
        start = self.lines.where("is_first").select("doc", "page", "chunk", F.col("begins").alias("second"), F.col("line_id").alias("second_id"))
        piece = start.select("doc", "page", (F.col("chunk") - 1).alias("chunk"), F.struct("second", "second_id").alias("here"))
        page = start.where("chunk = 0").select("doc", (F.col("page") - 1).alias("page"), F.struct("second", "second_id").alias("there"))
        over = over.join(piece, ["doc", "page", "chunk"], "left").join(page, ["doc", "page"], "left").withColumn("s", F.coalesce("here", "there"))
        over = over.select("table_name", "field_name", "row_id", "first", "mark", "s.second", "s.second_id")
        inside = self.fields.where("splits is not null").select("table_name", "field_name", "row_id", F.explode("splits").alias("s"))
        inside = inside.select("table_name", "field_name", "row_id", "s.*", F.col("row_id").alias("second_id"))
        every = within.unionByName(over).unionByName(inside).where("second is not null")
        return every.where(F.lower(F.substring("second", 1, 1)) == F.substring("second", 1, 1))

    def _judged(self) -> DataFrame:
        """The splits with joined (both halves as one word, null if the hyphen belongs to it) and
        meant (what the joined word was, null if it was read well)."""
        pairs = self.splits.select(F.lower("first").alias("a"), F.lower("second").alias("b")).distinct()
        whole, compound = F.concat("a", "b"), F.concat("a", F.lit("-"), "b")
        pairs = pairs.select("a", "b", whole.alias("whole"), compound.alias("compound"))
        counts = self.vocabulary
        for column, name in (("whole", "n_whole"), ("compound", "n_compound"), ("a", "n_a"), ("b", "n_b")):
            counted = counts.select(F.col("word").alias(column), F.col("n").alias(name))
            pairs = pairs.join(counted, column, "left")
        pairs = pairs.join(self.misread.withColumnRenamed("word", "whole"), "whole", "left").fillna(0, ["n_whole", "n_compound", "n_a", "n_b"])
        known = (F.col("n_whole") > 0) | F.col("meant").isNotNull()
        split = F.when(known & (F.col("n_whole") >= F.col("n_compound")), True).when(F.col("n_compound") > 0, False)
        split = split.when(known, True).otherwise(~((F.col("n_a") >= 3) & (F.col("n_b") >= 3)))
        pairs = pairs.select("a", "b", "meant", split.alias("is_split"))
        # AQE splits the rows of a frequent pair; pairs has each once
        rows = self.splits.withColumns({"a": F.lower("first"), "b": F.lower("second")}).join(pairs, ["a", "b"])
        always = F.col("mark").isin(list(BREAKS))
        return rows.withColumn("is_split", F.col("is_split") | always).drop("a", "b")

    def _misread_rows(self) -> DataFrame:
        """table_name, field_name, row_id, word and meant of the misread words."""
        listed = small(self.misread)
        whole = self.lines.where("label = 'body'").select(F.lit("page_lines").alias("table_name"), F.lit("text").alias("field_name"), F.col("line_id").alias("row_id"), "words")
        whole = whole.unionByName(self.fields.select("table_name", "field_name", "row_id", "words"))
        found = whole.select("table_name", "field_name", "row_id", F.explode(F.array_distinct("words")).alias("word")).join(listed, "word")
        # a first word that was left out of the counts, where no split precedes it, is a whole word
        starts = self.lines.where("label = 'body' and opens and begins is not null").select(F.col("line_id").alias("row_id"), F.lower("begins").alias("word"))
        seconds = self.judged.where("is_split and table_name = 'page_lines'").select(F.col("second_id").alias("row_id")).distinct()
        starts = starts.join(seconds, "row_id", "left_anti").select(F.lit("page_lines").alias("table_name"), F.lit("text").alias("field_name"), "row_id", "word").join(listed, "word")
        halves = self.judged.where("is_split and meant is not null")
        first = F.lower("first")
        in_first = ~F.col("meant").startswith(first)
        broken = halves.select("table_name", "field_name", F.when(in_first, F.col("row_id")).otherwise(F.col("second_id")).alias("row_id"), F.concat(first, F.lower("second")).alias("word"), "meant")
        kept = self.judged.where("not is_split")
        apart = kept.select("table_name", "field_name", "row_id", F.lower("first").alias("word")).unionByName(kept.select("table_name", "field_name", F.col("second_id").alias("row_id"), F.lower("second").alias("word")))
        columns = ["table_name", "field_name", "row_id", "word", "meant"]
        parts = [x.select(*columns) for x in (found, starts, broken, apart.join(listed, "word"))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()

    def faults(self) -> DataFrame:
        """table_name, field_name, row_id and fault: furniture, broken_word or misread."""
        keys = ["table_name", "field_name", "row_id"]
        lines = self.lines.where("label = 'furniture'").select(F.lit("page_lines").alias("table_name"), F.lit("text").alias("field_name"), F.col("line_id").alias("row_id"), F.lit("furniture").alias("fault"))
        inside = self.fields.where("furniture").select(*keys, F.lit("furniture").alias("fault"))
        broken = self.judged.where("is_split").select(*keys, F.lit("broken_word").alias("fault"))
        misread = self._misread_rows().select(*keys, F.lit("misread").alias("fault"))
        return lines.unionByName(inside).unionByName(broken).unionByName(misread).distinct()

    def _corrected(self) -> DataFrame:
        """Of each row with faults in words: the corrections, word by word, and the splits."""
        words = self._misread_rows().groupBy("table_name", "field_name", "row_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "meant"))).alias("corrections"))
        splits = self.judged.groupBy("table_name", "field_name", "row_id").agg(F.collect_set(F.struct("first", "mark", "second", "is_split", "meant")).alias("splits"))
        return words.join(splits, ["table_name", "field_name", "row_id"], "full_outer")

    def repaired_fields(self) -> DataFrame:
        """table_name, field_name, row_id, text and repaired: one readable paragraph."""
        both = self.fields.select("table_name", "field_name", "row_id", "text", "cleaned").join(self._corrected(), ["table_name", "field_name", "row_id"], "left")
        return both.select("table_name", "field_name", "row_id", "text", F.pandas_udf(_repaired, "string")("cleaned", "corrections", "splits").alias("repaired"))

    def paragraphs(self) -> DataFrame:
        """doc, page, paragraph (from 1 in its page), text and lines of the readable paragraphs of
        the pages. A paragraph ends at a break or an indent; a word split over a page's end is
        completed on the page where it begins. Of a page of more than PAGE_LINES lines each piece
        counts its own paragraphs."""
        corrected = self._corrected().where("table_name = 'page_lines'").select(F.col("row_id").alias("line_id"), "corrections", "splits")
        given = self.judged.where("is_split and table_name = 'page_lines'").select(F.col("second_id").alias("line_id"), F.lit(True).alias("gives")).distinct()
        rows = self.lines.select("doc", "page", "chunk", "line_id", "at", "text", "label").join(corrected, "line_id", "left").join(given, "line_id", "left")
        ordered = rows.repartition(*PAGE).sortWithinPartitions(*PAGE, "at")
        return ordered.mapInPandas(_paragraphs, PARAGRAPHS).drop("chunk")


def _meant(word: str, corrections: dict[str, str] | None) -> str:
    new = (corrections or {}).get(word.lower())
    if new is None:
        return word
    return new.upper() if word.isupper() and len(word) > 1 else new.capitalize() if word[:1].isupper() else new


def _like(word: str, lower: str) -> str:
    return lower.capitalize() if word[:1].isupper() else lower


def repaired_text(text: str, corrections: dict[str, str] | None, splits: list | None) -> str:
    """A text with its splits joined, its words corrected and its white space made single."""
    decided = {(s["first"], s["mark"], s["second"]): s for s in (splits if splits is not None else [])}

    def join(m: re.Match) -> str:
        s = decided.get((m.group(1), m.group(2), m.group(4)))
        if s is None:
            return m.group()
        if s["is_split"]:
            return _like(m.group(1), s["meant"]) if s["meant"] else m.group(1) + m.group(4)
        return m.group(1) + "-" + ("" if "\n" in m.group(3) else " ") + m.group(4)

    return re.sub(r"\s+", " ", WORD.sub(lambda m: _meant(m.group(), corrections), _INNER.sub(join, text))).strip()


def _repaired(texts: pd.Series, corrections: pd.Series, splits: pd.Series) -> pd.Series:
    return pd.Series([repaired_text(t, dict(c) if c is not None else None, list(s) if s is not None else None) if t is not None else None for t, c, s in zip(texts, corrections, splits)], dtype=object)


PARAGRAPHS = "doc string, page int, chunk int, paragraph int, n_lines int, text string"


def _paragraphs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines sorted by page to paragraphs; one paragraph is held at a time."""
    page, number, held = None, 0, None

    def closed() -> list[tuple]:
        return [(*page, number, held[0], re.sub(r"- (?=[a-z])", "-", held[1]))] if held else []

    for frame in frames:
        out = []
        for where, text, label, corrections, splits, gives in zip(zip(frame["doc"], frame["page"], frame["chunk"]), frame["text"], frame["label"], frame["corrections"], frame["splits"], frame["gives"]):
            if where != page:
                out += closed()
                page, number, held = where, 0, None
            if label == "furniture":
                continue
            if label == "break" or text[:2].isspace():
                out += closed()
                held = None
            if label == "break":
                continue
            if gives is True:  # its first word went to the line before
                text = text[_BEGINS.match(text).end() :].lstrip(" ")
            done = [s for s in (list(splits) if splits is not None else []) if s["is_split"]]
            line = text.rstrip()
            if done and (end := _ENDS.search(line)):
                whole = _like(done[0]["first"], done[0]["meant"]) if done[0]["meant"] else done[0]["first"] + done[0]["second"]
                line = line[: end.start()] + whole
            line = repaired_text(line, dict(corrections) if corrections is not None else None, None)
            if held:
                held = (held[0] + 1, held[1] + ("" if gives is True and not line[:1].isalnum() else " ") + line)
            else:
                number, held = number + 1, (1, line)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PARAGRAPHS.split(", ")])
    yield pd.DataFrame(closed(), columns=[c.split()[0] for c in PARAGRAPHS.split(", ")])
