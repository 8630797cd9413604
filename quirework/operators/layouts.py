"""Entries read from lines that are laid out in columns, indents or paragraphs.

Lines come with doc and position (an integer that orders a document). Where an entry begins is an
expression over the line and its neighbours; entries are then runs of lines, numbered by a
running sum. Only the plain layout depends on its own earlier decisions, so it is a state
machine over the sorted lines of a partition, which holds one entry at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quirework.functions.text import NUMBERED, dehyphenate, entry_warnings, indent_width, looks_like_term, shifted_decode
from quirework.operators.ordered import next_text, running_sum

#: Positions of one span: four pages of PAGE positions.
PAGE, COLUMN = 1_000_000, 10_000
SPAN = 4 * PAGE
LAYOUTS = ("numbered", "plain", "indent", "para", "colon")


def positions(lines: DataFrame) -> DataFrame:
    """line_id, doc, page, position and text of page lines; null texts are blank lines."""
    at = F.coalesce("page", F.lit(0)).cast("bigint") * PAGE + F.coalesce("col_no", F.lit(0)) * COLUMN + F.coalesce("line_no", F.lit(0))
    return lines.select("line_id", "doc", "page", at.alias("position"), F.coalesce("text", F.lit("")).alias("text"))


def _gathered(marked: DataFrame) -> DataFrame:
    """Entries of lines with is_start and text: doc, entry_no, term, definition, n_lines. Lines
    before a document's first start are dropped."""
    numbered = running_sum(marked.withColumn("_start", F.when(F.col("is_start"), 1).otherwise(0)), ["doc"], "position", "_start", "entry_no", SPAN)
    kept = numbered.where("entry_no > 0 and trim(text) <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("position", "line_id", "text")))
    grouped = kept.groupBy("doc", "entry_no").agg(ordered.alias("_lines"), F.count("*").alias("n_lines"))
    texts = F.transform("_lines", lambda x: x["text"])
    return grouped.select("doc", "entry_no", F.trim(texts[0]).alias("term"), dehyphenate(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0)))).alias("definition"), "n_lines")


def read_numbered(lines: DataFrame) -> DataFrame:
    """A term is an unnumbered line before one that starts with 1."""
    led = next_text(lines, ["doc"], "position", "text", "following", SPAN)
    start = (F.trim("text") != "") & ~F.trim("text").rlike(NUMBERED) & F.trim("following").startswith("1.")
    return _gathered(led.withColumn("is_start", start))


def read_indent(lines: DataFrame) -> DataFrame:
    """A term is a line before one that is indented further, unless it reads as running text."""
    led = next_text(lines, ["doc"], "position", "text", "following", SPAN)
    text, after = F.trim("text"), F.trim("following")
    start = (
        (text != "") & (indent_width(F.col("following")) > indent_width(F.col("text"))) & ~text.rlike(NUMBERED)
        & ~(after.rlike(NUMBERED) & ~after.startswith("1.")) & (~text.rlike(r"[.!?”\"]$") | (F.length(text) <= 12)) & (F.length(text) <= 45)
    )
    return _gathered(led.withColumn("is_start", start))


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc, paragraph (its number), position, lines (in order): runs of lines between blank ones."""
    blank = F.when(F.trim("text") == "", 1).otherwise(0)
    numbered = running_sum(lines.withColumn("_blank", blank), ["doc"], "position", "_blank", "paragraph", SPAN)
    ordered = F.array_sort(F.collect_list(F.struct("position", "line_id", "text")))
    kept = numbered.where("trim(text) <> ''").groupBy("doc", "paragraph").agg(ordered.alias("_lines"))
    return kept.select("doc", "paragraph", F.col("_lines")[0]["position"].alias("position"), F.col("_lines")[0]["line_id"].alias("line_id"), F.transform("_lines", lambda x: F.trim(x["text"])).alias("lines"))


def _merged(parts: DataFrame, join=dehyphenate) -> DataFrame:
    """Entries of paragraphs with is_start, term and body: the others continue the entry before."""
    numbered = running_sum(parts.withColumn("_start", F.when(F.col("is_start"), 1).otherwise(0)), ["doc"], "position", "_start", "entry_no", SPAN)
    ordered = F.array_sort(F.collect_list(F.struct("position", "line_id", "term", "body", F.size("lines").alias("n"))))
    grouped = numbered.where("entry_no > 0").groupBy("doc", "entry_no").agg(ordered.alias("_p"))
    bodies = F.transform("_p", lambda x: x["body"])
    n_lines = F.aggregate("_p", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    return grouped.select("doc", "entry_no", F.col("_p")[0]["term"].alias("term"), join(bodies).alias("definition"), n_lines.alias("n_lines"))


def read_para(lines: DataFrame, max_term: int = 45) -> DataFrame:
    """A paragraph's first line is the term, if it is short, ends without a comma or stop, starts
    with no small letter and isn't alone; the first paragraph always begins an entry."""
    parts = paragraphs(lines)
    first = F.col("lines")[0]
    is_term = (F.length(first) <= max_term) & ~first.rlike("[.,;]$") & ~first.rlike(r"^\p{Ll}") & (F.size("lines") > 1)
    opens = F.col("position") == F.min("position").over(Window.partitionBy("doc"))
    parts = parts.withColumn("is_start", is_term | opens)
    rest = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    body = dehyphenate(F.when(F.col("is_start"), rest).otherwise(F.col("lines")))
    return _merged(parts.withColumn("term", first).withColumn("body", body))


def read_inline(lines: DataFrame) -> DataFrame:
    """A paragraph's first word is the term, unless the paragraph starts in lower case."""
    parts = paragraphs(lines).withColumn("whole", dehyphenate(F.col("lines")))
    opens = F.col("position") == F.min("position").over(Window.partitionBy("doc"))
    parts = parts.withColumn("is_start", ~F.col("lines")[0].rlike(r"^\p{Ll}") | opens)
    body = F.when(F.col("is_start"), F.regexp_extract("whole", r"(?s)^\S+\s+(.*)$", 1)).otherwise(F.col("whole"))
    return _merged(parts.withColumn("term", F.regexp_extract("whole", r"^(\S+)", 1)).withColumn("body", body))


def read_colon(lines: DataFrame, max_term: int = 60) -> DataFrame:
    """A paragraph "Term: definition" begins an entry, any other continues it after a space, also
    where a hyphen stands before."""
    parts = paragraphs(lines).withColumn("whole", dehyphenate(F.col("lines")))
    pattern = rf"(?s)^([^:]{{1,{max_term}}}):\s*(.*)$"
    parts = parts.withColumn("is_start", F.col("whole").rlike(pattern))
    body = F.when(F.col("is_start"), F.trim(F.regexp_extract("whole", pattern, 2))).otherwise(F.col("whole"))
    spaced = lambda bodies: F.array_join(F.filter(bodies, lambda b: b != ""), " ")
    return _merged(parts.withColumn("term", F.trim(F.regexp_extract("whole", pattern, 1))).withColumn("body", body), spaced)


class _Plain:
    """The plain layout's state: the open entry's lines and the text before."""

    def __init__(self):
        self.doc, self.held, self.before, self.number = None, None, "", 0

    def take(self, doc: str, text: str, like_term: bool) -> tuple | None:
        done = None
        if doc != self.doc:
            done = self.close()
            self.doc, self.held, self.before, self.number = doc, None, "", 0
        if not text:
            self.before = ""
            return done
        ended = self.before == "" or self.before[-1] in ".!?)”\"’…"
        if like_term and ended and (self.held is None or len(self.held) > 1):
            done = self.close() or done
            self.held = [text]
        elif self.held is not None:
            self.held.append(text)
        self.before = text
        return done

    def close(self) -> tuple | None:
        if self.held is None:
            return None
        self.number += 1
        return self.doc, self.number, self.held[0], self.held[1:], len(self.held)


def read_plain(lines: DataFrame) -> DataFrame:
    """A term is a line that looks like one after a blank line or a sentence's end, once the entry
    before has some definition. A document's lines are read in order by one task, which holds one
    entry; the sort before it spills."""
    columns = ["doc", "entry_no", "term", "_rest", "n_lines"]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = _Plain()
        for frame in frames:
            found = [e for row in zip(frame["doc"].tolist(), frame["text"].tolist(), frame["like"].tolist()) if (e := state.take(*row))]
            yield pd.DataFrame(found, columns=columns)
        last = state.close()
        yield pd.DataFrame([last] if last else [], columns=columns)

    text = F.trim("text")
    ready = lines.select("doc", "position", "line_id", text.alias("text"), F.coalesce(looks_like_term(text), F.lit(False)).alias("like"))
    ordered = ready.repartition("doc").sortWithinPartitions("doc", "position", "line_id")
    made = ordered.mapInPandas(task, "doc string, entry_no bigint, term string, _rest array<string>, n_lines bigint")
    return made.select("doc", "entry_no", "term", dehyphenate(F.col("_rest")).alias("definition"), "n_lines")


READERS = {"numbered": read_numbered, "plain": read_plain, "indent": read_indent, "para": read_para, "inline": read_inline, "colon": read_colon}


def draft_entries(lines: DataFrame, layout: str) -> DataFrame:
    """The entries of lines by the named layout, with their warnings."""
    return READERS[layout](lines).withColumn("warnings", entry_warnings(F.col("term"), F.col("definition")))


def layout_scores(lines: DataFrame, layouts: tuple[str, ...] = LAYOUTS) -> DataFrame:
    """doc, layout and score (entries without warnings less two for each with one), with is_best;
    ties go to the layout named first."""
    every = None
    for rank, layout in enumerate(layouts):
        part = draft_entries(lines, layout).select("doc", F.lit(layout).alias("layout"), F.lit(rank).alias("rank"), (F.size("warnings") > 0).alias("odd"))
        every = part if every is None else every.unionByName(part)
    scores = every.groupBy("doc", "layout", "rank").agg((F.count_if(~F.col("odd")) - 2 * F.count_if("odd")).alias("score"))
    best = scores.groupBy("doc").agg(F.max_by("layout", F.struct(F.col("score"), -F.col("rank"))).alias("best"))
    return scores.join(best, "doc").select("doc", "layout", "score", (F.col("layout") == F.col("best")).alias("is_best"))


# ---- columns -----------------------------------------------------------------------------------


Bound = Column | int


def _spans(bounds: list[Bound]) -> list[tuple[Column, Column]]:
    """Where each column starts, from 1, and how wide it is; the last has no end."""
    edges = [F.lit(0), *(b if isinstance(b, Column) else F.lit(b) for b in bounds)]
    ends = [b - a for a, b in zip(edges, edges[1:])] + [F.lit(2**31 - 1)]
    return [(a + 1, n) for a, n in zip(edges, ends)]


def cut(line: Column, bounds: list[Bound]) -> Column:
    """The line's trimmed pieces between offsets, which may be the line's own."""
    return F.array(*(F.trim(F.substr(line, a, n)) for a, n in _spans(bounds)))


def cut_keeping_indent(lines: DataFrame, group: list[str], line: str, bounds: list[Bound]) -> DataFrame:
    """lines with pieces, each column shifted left so that its least indented line starts at 0."""
    raw = [F.rtrim(F.substr(F.col(line), a, n)) for a, n in _spans(bounds)]
    held = lines.withColumns({f"_c{k}": c for k, c in enumerate(raw)})
    least = held.groupBy(*group).agg(*(F.min(F.when(F.col(f"_c{k}") != "", indent_width(F.col(f"_c{k}")))).alias(f"_i{k}") for k in range(len(raw))))
    moved = [F.substr(f"_c{k}", F.coalesce(F.col(f"_i{k}"), F.lit(0)) + 1) for k in range(len(raw))]
    return held.join(least, group).withColumn("pieces", F.array(*moved)).select(*lines.columns, "pieces")


def segments(line: Column) -> Column:
    """start and text of a line's pieces between runs of two or more spaces."""
    pieces = F.regexp_extract_all(line, F.lit(r"( *)(\S+(?: \S+)*)"), F.lit(0))
    ends = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("done")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.array_append(s["done"], F.struct((s["at"] + F.length(p) - F.length(F.ltrim(p))).alias("start"), F.ltrim(p).alias("text"))).alias("done"),
        ),
    )
    return ends["done"]


def column_of(start: Column, starts: list[Bound]) -> Column:
    """The number of the last column that starts at most four characters after a segment."""
    return F.size(F.filter(F.array(*(s if isinstance(s, Column) else F.lit(s) for s in starts)), lambda s: s <= start + 4)) - 1


def word_starts(lines: DataFrame, group: list[str], line: str) -> DataFrame:
    """group, offset, n and score of the offsets where words start: a word after two spaces or at
    the line's start counts double; score adds the next offset's count."""
    text = F.rtrim(F.col(line))
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.struct((i - 1).alias("offset"), F.substr(text, i, F.lit(1)).alias("c"), F.when(i > 1, F.substr(text, i - 1, F.lit(1))).otherwise("").alias("b"), F.when(i > 2, F.substr(text, i - 2, F.lit(1))).otherwise("").alias("bb")))
    starting = F.filter(at, lambda x: (x["c"] != " ") & (x["c"] != "") & ((x["offset"] == 0) | (x["b"] == " ")))
    each = lines.where(F.trim(line) != "").select(*group, F.explode(starting).alias("s"))
    weight = F.when((F.col("s.offset") == 0) | ((F.col("s.offset") > 1) & (F.col("s.bb") == " ")), 2).otherwise(1)
    counted = each.groupBy(*group, F.col("s.offset").alias("offset")).agg(F.sum(weight).alias("n"))
    # at most as many rows in a group as a line is wide
    after = Window.partitionBy(*group).orderBy("offset")
    follows = F.lead("offset").over(after) == F.col("offset") + 1
    return counted.withColumn("score", F.col("n") + F.when(follows, F.lead("n").over(after)).otherwise(0))


def peaks(starts: DataFrame, group: list[str], n_columns: int, separation: int) -> DataFrame:
    """group and offsets: where the columns after the first start, by the highest scores that are
    far enough apart (ties to the right), without those in the first five characters."""
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("score", "offset"))))
    grouped = starts.groupBy(*group).agg(ranked.alias("_r"))
    chosen = F.aggregate(
        "_r", F.array().cast("array<int>"),
        lambda done, x: F.when((F.size(done) < n_columns) & F.forall(done, lambda d: F.abs(d - x["offset"]) >= separation), F.array_append(done, x["offset"])).otherwise(done),
    )
    return grouped.select(*group, F.slice(F.filter(F.array_sort(chosen), lambda o: o > 5), 1, n_columns - 1).alias("offsets"))


def offset_shares(lines: DataFrame, group: list[str], line: str, offsets: list[int], window: int = 1) -> DataFrame:
    """group, offset, cut_share and start_share of the lines that reach past each offset: with a
    word across it, with a word that starts at it or within `window` characters from it. Under
    five such lines all are cut, none start."""
    text = F.rtrim(F.col(line))
    each = lines.select(*group, text.alias("_t"), F.explode(F.array(*map(F.lit, offsets))).alias("offset")).where(F.length("_t") > F.col("offset"))
    across = ~F.contains(F.substr("_t", F.greatest(F.col("offset") - 1, F.lit(1)), F.lit(3)), F.lit(" "))
    start = lambda k: (F.substr("_t", F.col("offset") + k + 1, F.lit(1)) > " ") & (F.substr("_t", F.col("offset") + k, F.lit(1)) == " ")
    starts = reduce(or_, map(start, range(window)))
    few = F.count("*") < 5
    return each.groupBy(*group, "offset").agg(
        F.when(few, 1.0).otherwise(F.count_if(across) / F.count("*")).alias("cut_share"), F.when(few, 0.0).otherwise(F.count_if(starts) / F.count("*")).alias("start_share")
    )


def cut_drifting(line: Column, bounds: Column, tolerance: int = 8) -> Column:
    """The line's columns where columns drift: its segments (pieces between runs of two or more
    spaces), each in the last column that starts at most four characters after it. A segment that
    runs more than `tolerance` characters past a column's start is cut at the space nearest that
    start, if one is within six characters; segments of one column are joined by a space.

    An Arrow UDF, as a cut depends on the cut before. bounds is an array of the starts of all
    columns but the first; null lines give null.
    """

    def each(lines: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([drifting_columns(t, [int(b) for b in s], tolerance) if t is not None else None for t, s in zip(lines, starts)], dtype=object)

    return F.pandas_udf(each, "array<string>")(line, bounds)


_SEGMENT = re.compile(r"\S+(?: \S+)*")


def drifting_columns(line: str, bounds: list[int], tolerance: int) -> list[str]:
    """One line's text in each column."""
    starts, row = [0, *bounds], [[] for _ in range(len(bounds) + 1)]
    waiting = [(m.start(), m.group()) for m in _SEGMENT.finditer(line)][::-1]
    while waiting:
        start, text = waiting.pop()
        # a start up to three characters on is the segment's own column
        crossed = next((b - start for b in bounds if b > start + 3 and start + len(text) > b + tolerance), None)
        spaces = [k for k in range(max(crossed - 6, 0), crossed + 7) if text[k : k + 1] == " "] if crossed is not None else []
        if spaces:
            at = min(spaces, key=lambda k: abs(k - crossed))
            waiting.append((start + at + 1, text[at + 1 :]))
            text = text[:at]
        row[max(k for k, s in enumerate(starts) if k == 0 or s <= start + 4)].append(text)
    return [" ".join(t for t in texts if t) for texts in row]


def _offset_counts(line: str) -> tuple[np.ndarray, ...]:
    """Of each offset of a line without space at its end: whether a word runs across it, starts at
    it, and starts at it or within two characters after."""
    space = np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32
    before = np.r_[True, space[:-1]]
    starts = ~space & before
    starts[0] = False
    across = ~(space | before & (np.arange(len(space)) > 0) | np.r_[False, False, space[:-2]][: len(space)])
    soon = starts | np.r_[starts[1:], False] | np.r_[starts[2:], False, False][: len(space)]
    return across, starts, soon


def offset_counts(lines: DataFrame, group: list[str], line: str) -> DataFrame:
    """group, offset, n (lines that reach past it), and how many of them have a word across it,
    start one at it, or within three characters from it. Counted within each batch, then summed:
    no page is gathered."""
    names = [*group, "offset", "n", "across", "starts", "soon"]
    schema = StructType([*(lines.schema[c] for c in group), *(StructField(c, LongType()) for c in names[len(group) :])])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # keys are taken from their rows, so nulls and types stay as they are
            keys = [batch.column(c).dictionary_encode("encode").indices.to_numpy() for c in group]
            _, first, page_of = np.unique(np.c_[tuple(keys)], axis=0, return_index=True, return_inverse=True)
            pages: list[list[str]] = [[] for _ in first]
            for k, text in zip(page_of.ravel(), batch.column("_line").to_pylist()):
                if text:
                    pages[k].append(text)
            for at, texts in zip(first, pages):
                if not texts:  # no offset to count
                    continue
                counts = np.zeros((4, max(map(len, texts))), np.int64)
                for text in texts:
                    counts[0, : len(text)] += 1
                    counts[1:, : len(text)] += _offset_counts(text)
                own = pa.array(np.full(counts.shape[1], at))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in group), pa.array(np.arange(counts.shape[1])), *map(pa.array, counts)], names=names)

    counted = lines.select(*group, F.rtrim(line).alias("_line")).mapInArrow(task, schema)
    return counted.groupBy(*group, "offset").agg(*(F.sum(c).alias(c) for c in ("n", "across", "starts", "soon")))


#: A column is at least so wide; its start is looked for so far around a candidate; at most so many
#: lines may have a word across it; an offset is a candidate if so many have a word start there.
NARROWEST, NUDGE, MOST_CUT, LEAST_STARTS = 25, 6, 0.1, 0.5


def column_starts(lines: DataFrame, group: list[str], line: str) -> DataFrame:
    """group and starts: where the second and third columns of a page start, empty for one column.

    Candidates are the offsets with most word starts (peaks of six columns) and those where half the
    lines that reach them start a word; each is moved to where, nearby, fewest words are cut, then
    most start, then it is nearest. Of what cuts few words the first two that are far enough apart
    are taken. Offsets that under five lines reach count as cut.
    """
    few = F.col("n") < 5
    shares = offset_counts(lines, group, line).select(
        *group, "offset", F.when(few, 1.0).otherwise(F.col("across") / F.col("n")).alias("cut"), F.when(few, 0.0).otherwise(F.col("starts") / F.col("n")).alias("start"),
        (~few & (F.col("soon") / F.col("n") >= LEAST_STARTS) & (F.col("offset") >= NARROWEST)).alias("likely"),
    )
    # offsets are without gaps from 0, as many as the page's longest line is wide
    pages = shares.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("offset", "cut", "start", "likely"))).alias("_at"))
    found = peaks(word_starts(lines, group, line), group, 6, 10).withColumnsRenamed({c: f"_{c}" for c in group})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group))
    both = pages.join(found, same, "left")
    likely = F.transform(F.filter("_at", lambda x: x["likely"]), lambda x: x["offset"].cast("int"))
    tried = F.array_distinct(F.concat(F.coalesce("offsets", F.array().cast("array<int>")), likely))

    def cleanest(start: Column) -> Column:
        def judged(o: Column) -> Column:
            here = F.try_element_at(F.col("_at"), o + 1)
            return F.struct(F.coalesce(here["cut"], F.lit(1.0)).alias("cut"), (-F.coalesce(here["start"], F.lit(0.0))).alias("start"), F.abs(o - start).alias("away"), o.alias("offset"))

        return F.array_min(F.transform(F.sequence(F.greatest(start - NUDGE, F.lit(1)), start + NUDGE), judged))

    nudged = F.array_sort(F.array_distinct(F.transform(tried, lambda c: F.struct(cleanest(c)["offset"].alias("offset"), cleanest(c)["cut"].alias("cut")))))
    kept = F.aggregate(
        nudged, F.array().cast("array<int>"),
        lambda done, x: F.when((x["cut"] <= MOST_CUT) & (x["offset"] - F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) >= NARROWEST), F.array_append(done, x["offset"])).otherwise(done),
    )
    return both.select(*group, F.slice(kept, 1, 2).alias("starts"))


def locate(entries: DataFrame, lines: DataFrame, starts_line: bool = False) -> DataFrame:
    """doc, entry_no, page and is_certain: where each entry's term is, searched on from just after
    the one before; a term that isn't found takes the page where its search would have begun. A
    line has a term if it is that term or, where the layout's terms open a line, starts with it.
    A document is one task's, as each search depends on the last."""

    def task(found: pd.DataFrame, where: pd.DataFrame) -> pd.DataFrame:
        found, where = found.sort_values("entry_no"), where.sort_values(["position", "line_id"])
        texts, pages = where["text"].str.strip().tolist(), where["page"].tolist()
        in_order = sorted((t, k) for k, t in enumerate(texts))
        cursor, out = 0, []
        for doc, number, term in zip(found["doc"], found["entry_no"], found["term"]):
            at, k = None, bisect_left(in_order, (term, cursor if not starts_line else 0))
            while k < len(in_order) and (in_order[k][0] == term or starts_line and in_order[k][0].startswith(term)):
                if in_order[k][1] >= cursor and (at is None or in_order[k][1] < at):
                    at = in_order[k][1]
                    if not starts_line:
                        break
                k += 1
            if at is not None:
                cursor = at + 1
            page = pages[at] if at is not None else pages[min(cursor, len(pages) - 1)] if pages else None
            out.append((doc, number, page, at is not None))
        return pd.DataFrame(out, columns=["doc", "entry_no", "page", "is_certain"]).astype({"page": "Int64"})

    # entries may come from the same lines, so each side has columns of its own
    own = lambda df, *columns: df.select(*(F.col(c).alias(f"_{c}") for c in columns)).withColumnsRenamed({f"_{c}": c for c in columns})
    left, right = own(entries, "doc", "entry_no", "term"), own(lines, "doc", "page", "position", "line_id", "text")
    return left.groupBy(left["doc"]).cogroup(right.groupBy(right["doc"])).applyInPandas(task, "doc string, entry_no bigint, page bigint, is_certain boolean")


def phrase_lines(texts: DataFrame, row_id: str, text: str, phrase: str, width: int = 160) -> DataFrame:
    """row_id, page, line_no and the first characters of every line that has the phrase, as it is
    or with its shifted runs decoded, whatever the case.

    Page and line count from 1, lines anew on each page. A text without form feeds has no pages:
    page is null and the line stays as it is; else the line is decoded.
    """
    paged = F.contains(F.col(text), F.lit("\f"))
    pages = texts.select(row_id, paged.alias("_paged"), F.posexplode(F.split(F.col(text), r"\f")).alias("_page", "_text"))
    breaks = r"\r\n|[\n\r\x{0B}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
    each = pages.select(row_id, F.when(F.col("_paged"), F.col("_page") + 1).alias("page"), F.posexplode(F.split("_text", breaks)).alias("n", "line"))
    wanted, decoded = F.lit(phrase.lower()), shifted_decode(F.col("line"))
    found = each.where(F.contains(F.lower("line"), wanted) | F.contains(F.lower(decoded), wanted))
    shown = F.when(F.col("page").isNotNull(), decoded).otherwise(F.col("line"))
    return found.select(row_id, "page", (F.col("n") + 1).alias("line_no"), F.substring(F.trim(shown), 1, width).alias("line"))
