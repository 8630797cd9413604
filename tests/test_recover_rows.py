import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.operators.recover_rows import FIELDS, cheapest_parse, faults, parse_line, parse_lines, rejected_lines, valid_entries

KEY = "owlmanac-2016"


@pytest.mark.parametrize(
    ("line", "cost", "values", "edits"),
    [
        (f"a\tb\t{KEY}\tp.1", 0, ["a", "b", KEY, "p.1"], []),
        (f"a\t\t{KEY}\t", 0, ["a", "", KEY, ""], []),
        (f'a\t"b ""x"" c"\t{KEY}\t', 0, ["a", 'b "x" c', KEY, ""], []),
        (f'a\t"b\tc"\t{KEY}\tp.3', 0, ["a", "b\tc", KEY, "p.3"], []),
        (f'a\tb "c"\t{KEY}\tp.3', 0, ["a", 'b "c"', KEY, "p.3"], []),
        (f"a\tb\tc\t{KEY}\tp.3", 1, ["a", "bc", KEY, "p.3"], ["delete tab at 3"]),
        (f"a\tb\t{KEY}", 1, ["a", "b", KEY, ""], [f"insert tab at {4 + len(KEY)}"]),
        (f'a\t"b\t{KEY}\tp.3', 1, ["a", "b", KEY, "p.3"], ["delete quote at 2"]),
        (f"a\tb\t{KEY}\tp.03", 1, ["a", "b", KEY, "p.03"], ["locator is not a page"]),
        (f"{'x' * 81}\tb\t{KEY}\t", 1, ["x" * 81, "b", KEY, ""], ["term is longer than 80 characters"]),
    ],
)
def test_cheapest_parse(line, cost, values, edits):
    assert cheapest_parse(line) == (cost, values, edits)


def plain_parse(line):
    """The rules read off one by one, without any repair."""
    fields, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            end, text = at + 1, ""
            while True:
                stop = line.find('"', end)
                if stop < 0:
                    return None
                text += line[end:stop]
                if line[stop + 1 : stop + 2] == '"':
                    text, end = text + '"', stop + 2
                else:
                    break
            at = stop + 1
            if at < len(line) and line[at] != "\t":
                return None
            fields.append(text)
        else:
            stop = line.find("\t", at)
            stop = len(line) if stop < 0 else stop
            fields.append(line[at:stop])
            at = stop
        if at >= len(line):
            return fields if len(fields) == 4 else None
        at += 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", '"', "\t", KEY, "p.1", " "]), max_size=12))
def test_zero_cost_is_the_rules(pieces):
    line = "".join(pieces)
    values = plain_parse(line)
    valid = values is not None and not faults(values)
    cost, found, _ = parse_line(line)
    assert (cost <= 0) == (valid or values == list(FIELDS))
    if valid:
        assert found == values


def test_every_short_line_has_a_parse():
    for line in map("".join, itertools.product('a"\t', repeat=5)):
        cost, values, edits = cheapest_parse(line)
        assert len(values) == 4
        assert (cost == 0) == (edits == [])


def test_lines_on_a_dataframe(spark):
    lines = [
        (1, "﻿term\tdefinition\tsource_key\tlocator\r", 7), (2, "# note", 7), (3, "", 7), (4, None, 7), (5, f"a\tb\t{KEY}\tp.12\r", 7),
        (6, f"a\tb\t{KEY}\tp.12\r", 7), (7, "one field", 7), (8, f'"x\ty"\t"{"z" * 100000}"\t{KEY}\t', 7), (9, f"\xa0\tb\t{KEY}\t", 7), (10, f"a\t�\t{KEY}\t", 7),
    ]
    parsed = parse_lines(spark.createDataFrame(lines, "line_id long, raw_line string, cost int"))
    good, bad = valid_entries(parsed), rejected_lines(parsed)
    assert sorted((r.line_id, r.page) for r in good.collect()) == [(5, 12), (6, 12), (8, None)]
    reasons = {r.line_id: r.reason for r in bad.collect()}
    assert set(reasons) == {7, 9, 10} and reasons[9] == "term is blank"
    assert good.columns == ["line_id", "term", "definition", "source_key", "locator", "page"]


def test_no_lines(spark):
    assert parse_lines(spark.createDataFrame([], "line_id long, raw_line string")).count() == 0


@pytest.mark.parametrize(
    ("line", "cost"),
    [("a\x01b\tc\towlmanac-2016\tp.1", 1), ("a\x01\tb\x02\towlmanac-2016\t", 2), ("a\x01\tb\x02 x\x03\tother\tp.01", 4), ('"a\x01""b\x02"\tc\towlmanac-2016\t', 1), ("a\x01\tb\towlmanac-2016", 2)],
)
def test_the_cost_is_that_of_the_parse_that_is_returned(line, cost):
    found, _, edits = cheapest_parse(line)
    assert found == len(edits) == cost
