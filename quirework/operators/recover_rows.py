"""Rows that fail to parse: load the valid lines typed, set the others apart with the reason.

A line is parsed at minimum cost by dynamic programming over its tokens (tab, quote, text):
at a cost of one each a tab or a quote may be inserted or deleted, and a field may break its
type. A line whose cheapest parse costs nothing is a valid record; of any other line the edits
and broken types of the cheapest parse are the reason.

For a line with no field that starts with a quote the zero-cost layer of the programme is just
the split at tabs, so Spark's own expressions take it there; only lines with such a field, or
with faults, go to Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("term", "definition", "source_key", "locator")
MAX_TERM = 80
SOURCE_KEY = "owlmanac-2016"

#: Java patterns of the field types.
CONTROL_JAVA = r"[\x{00}-\x{08}\x{0A}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]"
BLANK_JAVA = r"^\p{IsWhite_Space}*$"
LOCATOR_JAVA = r"^(p\.[1-9][0-9]*)?$"

CONTROL = re.compile("[\x00-\x08\x0a-\x1f\x7f-\x9f�]")
LOCATOR = re.compile(r"(p\.[1-9][0-9]*)?\Z")

RESULT = "cost int, term string, definition string, source_key string, locator string, edits array<string>"

# ---- the parse -------------------------------------------------------------------------------


def faults(values: list[str], source_key: str = SOURCE_KEY) -> list[str]:
    """The broken types of four field values."""
    term, definition, key, locator = values
    found = []
    if not term.strip():
        found.append("term is blank")
    if len(term) > MAX_TERM:
        found.append(f"term is longer than {MAX_TERM} characters")
    if CONTROL.search(term):
        found.append("term has a control or replacement character")
    if CONTROL.search(definition):
        found.append("definition has a control or replacement character")
    if key != source_key:
        found.append("source_key is not " + source_key)
    if not LOCATOR.match(locator):
        found.append("locator is not a page")
    return found


def tokens_of(line: str) -> list[tuple[str, int]]:
    """Tabs, quotes and the runs of text between them, each with its offset."""
    return [(m.group(), m.start()) for m in re.finditer(r'\t|"|[^\t"]+', line)]


_FIELD = r'(?:"([^"]*+(?:""[^"]*+)*+)"|((?!")[^\t]*+))'
#: A line whose structure costs nothing.
WHOLE = re.compile("\t".join([_FIELD] * 4) + r"\Z")


def free_parse(line: str) -> list[str] | None:
    """The zero-cost layer of the programme, which is a regular language: the four values of a
    line whose quotes and tabs need no edit, else None."""
    found = WHOLE.match(line)
    if not found:
        return None
    groups = found.groups()
    return [plain if quoted is None else quoted.replace('""', '"') for quoted, plain in zip(groups[::2], groups[1::2])]


def parse_line(line: str, source_key: str = SOURCE_KEY) -> tuple[int, list[str], list[str]]:
    """cheapest_parse, which a line without faults doesn't need; cost -1 marks a header."""
    values = free_parse(line)
    if values is not None:
        if tuple(values) == FIELDS:
            return -1, values, []
        if not faults(values, source_key):
            return 0, values, []
    return cheapest_parse(line, source_key)


def cheapest_parse(line: str, source_key: str = SOURCE_KEY) -> tuple[int, list[str], list[str]]:
    """The cost, the four values and the edits of a line's cheapest parse.

    A state is (field number, mode, kind, stained): mode S at a field's start, U in a plain field, Q
    in a quoted one, E after its closing quote; kind tells how much of the field there is (0 none,
    1 one text, 2 several tokens), stained whether a term or definition has paid for a control
    character. Only how long or blank a term of several tokens is gets known after its parse. States are few, so the time is linear in the line's length. Of
    parses at equal cost the one with fewer and later edits is kept, so the result is stable.
    """
    tokens = [*tokens_of(line), ("", len(line))]
    text_fits = {
        2: lambda s: s == source_key,
        3: lambda s: bool(s) and bool(LOCATOR.match(s)),
    }

    def close(field: int, kind: int, text: str) -> int:
        """The cost of ending a field here, for what its type asks."""
        if field == 0:
            return int(kind == 0 or (kind == 1 and (not text.strip() or len(text) > MAX_TERM)))
        if field == 1:
            return 0
        if field == 3 and kind == 0:
            return 0
        return int(not (kind == 1 and text_fits[field](text)))

    # state -> (cost, text of a one-text field, link); link = (previous link, operation)
    states: dict[tuple[int, str, int, bool], tuple[int, str, tuple | None]] = {(0, "S", 0, False): (0, "", None)}

    def put(into: dict, state: tuple, cost: int, text: str, link: tuple) -> None:
        if state not in into or cost < into[state][0]:
            into[state] = (cost, text, link)

    last = len(tokens) - 1
    for at, (token, offset) in enumerate(tokens):
        # insertions before the token: a delimiter, an opening or a closing quote
        queue = sorted(states.items(), key=lambda x: x[1][0])
        while queue:
            (field, mode, kind, stained), (cost, text, link) = queue.pop(0)
            if cost != states[field, mode, kind, stained][0]:
                continue
            made = []
            if mode == "S" and kind == 0:
                made.append(((field, "Q", 0, stained), cost + 1, "", (link, ("insert quote", offset, ""))))
            if mode == "Q":
                made.append(((field, "E", kind, stained), cost + 1, text, (link, ("insert quote", offset, ""))))
            if field < 3 and mode in "SUE":
                made.append(((field + 1, "S", 0, False), cost + 1 + close(field, kind, text), "", (link, ("insert tab", offset, "\t"))))
            for state, price, kept, way in made:
                if state not in states or price < states[state][0]:
                    states[state] = (price, kept, way)
                    queue.append((state, states[state]))
                    queue.sort(key=lambda x: x[1][0])
        if at == last:
            break
        following = tokens[at + 1][0]
        new: dict = {}
        for (field, mode, kind, stained), (cost, text, link) in states.items():
            more = min(2, kind + 1)
            if token == "\t":
                if mode == "Q":
                    put(new, (field, "Q", 2, stained), cost, "", (link, ("keep", offset, "\t")))
                else:
                    if field < 3:
                        put(new, (field + 1, "S", 0, False), cost + close(field, kind, text), "", (link, ("end", offset, "")))
                put(new, (field, mode, kind, stained), cost + 1, text, (link, ("delete tab", offset, "")))
            elif token == '"':
                if mode == "S":
                    put(new, (field, "Q", 0, stained), cost, "", (link, ("open", offset, "")))
                elif mode == "U":
                    put(new, (field, "U", 2, stained), cost, "", (link, ("keep", offset, '"')))
                elif mode == "Q":
                    if following != '"':
                        put(new, (field, "E", kind, stained), cost, text, (link, ("close", offset, "")))
                    else:
                        put(new, (field, "H", kind, stained), cost, text, (link, ("half", offset, "")))
                elif mode == "H":
                    put(new, (field, "Q", 2, stained), cost, "", (link, ("keep", offset, '"')))
                if mode != "H":
                    put(new, (field, mode, kind, stained), cost + 1, text, (link, ("delete quote", offset, "")))
            else:
                stains = field < 2 and not stained and bool(CONTROL.search(token))
                cost, stained = cost + stains, stained or stains
                if mode in "SU":
                    put(new, (field, "U", more, stained), cost, token if more == 1 else "", (link, ("keep", offset, token)))
                elif mode == "Q":
                    put(new, (field, "Q", more, stained), cost, token if more == 1 else "", (link, ("keep", offset, token)))
                elif mode == "E":  # text after the closing quote: that quote was data
                    put(new, (field, "Q", 2, stained), cost + 1, "", (link, ("insert quote", offset, '"' + token)))
        states = new
    ends = []
    for (field, mode, kind, _), (cost, text, link) in states.items():
        if field == 3 and mode in "SUE":
            ends.append((cost + close(field, kind, text), mode, kind, link))
    cost, _, _, link = min(ends, key=lambda x: x[:3])
    steps = []
    while link:
        link, step = link
        steps.append(step)
    values, edits = [""], []
    for name, offset, text in reversed(steps):
        if name == "end" or name == "insert tab":
            values.append("")
        else:
            values[-1] += text
        if name.startswith(("insert", "delete")):
            edits.append(f"{name} at {offset}")
    edits += faults(values, source_key)
    return max(cost, len(edits)), values, edits


# ---- on DataFrames ---------------------------------------------------------------------------


def line_text(raw: Column) -> Column:
    """The line without a leading U+FEFF and a trailing carriage return."""
    bare = F.when(raw.startswith("﻿"), F.substr(raw, F.lit(2))).otherwise(raw)
    return F.when(bare.endswith("\r"), F.substr(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)


def parse_lines(lines: DataFrame, raw: str = "raw_line", source_key: str = SOURCE_KEY) -> DataFrame:
    """Every record line of lines with its parse: the input's columns and `cost`, `parsed`
    (struct of the four fields), `edits`.

    cost 0: a valid record, edits is empty. Above 0: edits has the reasons, parsed the repair.
    Null lines, empty lines, lines that start with # and header lines are no records and are
    left out. Repeated lines stay, each judged alone. An empty table gives an empty table.
    Columns of the input that are named like the results are replaced; any other is kept.
    No shuffle: one pass over the lines.
    """
    if source_key != SOURCE_KEY and not source_key:
        raise ValueError("source_key must not be empty")
    text = line_text(F.col(raw))
    named = lines.drop("cost", "parsed", "edits").withColumn("_line", text)
    named = named.where(F.col("_line").isNotNull() & (F.col("_line") != "") & ~F.col("_line").startswith("#"))
    parts = F.split("_line", "\t", -1)
    plain = (F.size(parts) == 4) & ~F.col("_line").startswith('"') & ~F.contains("_line", F.lit('\t"'))
    term, definition, key, locator = (F.get(parts, i) for i in range(4))
    fits = (
        plain
        & ~term.rlike(BLANK_JAVA)
        & (F.length(term) <= MAX_TERM)
        & ~term.rlike(CONTROL_JAVA)
        & ~definition.rlike(CONTROL_JAVA)
        & (key == source_key)
        & locator.rlike(LOCATOR_JAVA)
    )
    split = F.struct(*(x.alias(n) for x, n in zip((term, definition, key, locator), FIELDS)))

    @F.pandas_udf(RESULT)
    def search(column: pd.Series) -> pd.DataFrame:
        done: dict[str | None, tuple] = {None: (None,) * 6}
        out = []
        for line in column:
            if line not in done:
                cost, values, edits = parse_line(line, source_key)
                done[line] = (cost, *values, edits)
            out.append(done[line])
            if len(done) > 20000:
                done = {None: (None,) * 6}
        return pd.DataFrame(out, columns=["cost", *FIELDS, "edits"])

    # a null goes to Python for the lines whose zero-cost parse is known
    searched = named.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    searched = searched.withColumn("_found", search(F.when(~F.col("_fits"), F.col("_line"))))
    found = F.col("_found")
    parsed = F.when(F.col("_fits"), split).otherwise(F.struct(*(found[n].alias(n) for n in FIELDS)))
    result = searched.withColumns(
        {
            "cost": F.when(F.col("_fits"), F.lit(0)).otherwise(found["cost"]),
            "parsed": parsed,
            "edits": F.when(F.col("_fits"), F.array().cast("array<string>")).otherwise(found["edits"]),
        }
    ).drop("_line", "_fits", "_found")
    return result.where("cost >= 0")


def valid_entries(parsed: DataFrame) -> DataFrame:
    """The valid records as typed entries: page is the locator's number, null without one."""
    kept = [c for c in parsed.columns if c not in ("cost", "parsed", "edits", "raw_line", *FIELDS, "page")]
    page = F.regexp_extract("parsed.locator", r"^p\.([0-9]+)$", 1)
    return parsed.where("cost = 0").select(
        *kept, *(F.col(f"parsed.{n}").alias(n) for n in FIELDS), page.try_cast("bigint").alias("page")
    )


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """The other records with the reason they failed, and the repair that the parse suggests."""
    return parsed.where("cost > 0").withColumn("reason", F.array_join("edits", "; "))
