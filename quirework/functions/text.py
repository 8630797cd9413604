"""Text functions: Column in, Column out, all built from Spark's own expressions unless said.

Null gives null throughout; empty text gives empty text.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of the windows-1252 bytes 80 to 9F that Latin-1 leaves as controls.
CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_CHARACTERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
#: Line ends of running text, as the usual line splitter has them.
LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def normalise_term(term: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, only a-z, 0-9 and single spaces; then the alias if there is one; then a leading
    "the" goes if what follows is an alias's target. aliases is configuration, so it is a literal."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower(term), "[^a-z0-9 ]", "")), " +", " ")
    if not aliases:
        return plain
    pairs = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    named = F.coalesce(F.try_element_at(pairs, plain), plain)
    bare = F.regexp_replace(named, "^the ", "")
    return F.when(named.startswith("the ") & bare.isin(sorted(set(aliases.values()))), bare).otherwise(named)


def normalise_definition(text: Column) -> Column:
    """Lower case, every run of other than letters, digits and underscore one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def slugify(text: Column, empty: str = "img") -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", empty).otherwise(slug)


def squash_name(name: Column) -> Column:
    """A name in lower case without anything but letters a-z and digits."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def heading_slug(heading: Column) -> Column:
    """The anchor of a heading: marks split off and dropped with all else beyond ASCII, then letters,
    digits, underscores, spaces and hyphens kept, in lower case, runs of spaces and hyphens one
    hyphen. An Arrow UDF where there is anything beyond ASCII, as the split has no built-in."""

    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() if isinstance(t, str) else None)

    beyond = heading.rlike(r"[^\x{00}-\x{7F}]")
    ascii_only = F.when(beyond, F.pandas_udf(plain, "string")(F.when(beyond, heading))).otherwise(heading)
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(ascii_only, r"[^\w\s-]", ""))), r"[-\s]+", "-")


def on_one_line(text: Column) -> Column:
    """A text trimmed, each line end a space, so that it stays inside its list item."""
    return F.replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))


def expand_ligature(character: Column) -> Column:
    """A single ligature character as the letters it joins; any other text as it is."""
    made = character
    for ligature, letters in zip("ﬀﬁﬂﬃﬄﬅﬆ", ("ff", "fi", "fl", "ffi", "ffl", "st", "st")):
        made = F.when(character == ligature, letters).otherwise(made)
    return made


def shorten(text: Column, width: int) -> Column:
    """At most width characters; what is cut off becomes an ellipsis."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def html_escape(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def html_unescape(text: Column) -> Column:
    """An Arrow UDF, as there is no built-in; text without & doesn't reach it."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(t) if isinstance(t, str) else None)

    has = F.contains(text, F.lit("&"))
    return F.when(has, F.pandas_udf(each, "string")(F.when(has, text))).otherwise(text)


def html_to_text(page: Column) -> Column:
    """Crude text of a page, in ten ordered steps whose quirks are part of the result: <link> gives
    a list mark, <br> or a closing tag counts only without attributes, a bare < eats up to the
    next >."""
    # The steps and their order are the required behaviour.
    steps = (
        (r"(?is)<(script|style|noscript).*?</\1>", " "),
        (r"(?is)<!--.*?-->", " "),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(?:p|div|li|tr|h[1-6]|blockquote|td|th|dt|dd|option|pre)>", "\n"),
        *((rf"(?i)<h{level}[^>]*>", "\n" + "#" * level + " ") for level in range(1, 7)),
        (r"(?i)<li[^>]*>", "- "),
        (r"<[^>]+>", " "),
    )
    text = page
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    text = F.regexp_replace(html_unescape(text), r"[ \t\r\x{A0}]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\n\s*\n+", "\n\n"), r"(?U)^\s+|\s+$", "")


def decode_bytes(data: Column) -> Column:
    """Bytes as text: UTF-8 if valid, else windows-1252, else (with a byte undefined there)
    Latin-1; one choice for the whole value."""
    latin = F.decode(data, "ISO-8859-1")
    undefined = latin.rlike(r"[\x{81}\x{8D}\x{8F}\x{90}\x{9D}]")
    windows = F.when(undefined, latin).otherwise(F.translate(latin, CP1252_BYTES, CP1252_CHARACTERS))
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(windows)


# Ligatures of a text layer as letters; the mark of a soft hyphen and the byte order
# mark are removed.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬀ": "ff", "¬": "", "﻿": ""}


def ligatures(text: Column) -> Column:
    """Printed ligatures as letters, marks of soft hyphens and byte order marks gone."""
    for seen, meant in LIGATURES.items():
        text = F.replace(text, F.lit(seen), F.lit(meant))
    return text


# What a font whose codes are 29 too low makes of ligatures and common words.
SHIFTED_LIGATURES = {"À": "fi", "Á": "fl", "Â": "ffi", "¿": "ff"}
# One marker that spells a proper name is left out: lines that hold no other are not decoded. Pass it
# as a marker where such lines are meant.
SHIFTED_MARKERS = ("WKH", "DQG", "RI", "WR", "LQ", "LV", "IRU", "ZLWK", "À", "Á")


def _unshifted(run: Column) -> Column:
    low = "".join(map(chr, [3, *range(0x21, 0x5E)]))
    made = F.translate(run, low, "".join(chr(ord(c) + 29) for c in low))
    for seen, meant in SHIFTED_LIGATURES.items():
        made = F.replace(made, F.lit(seen), F.lit(meant))
    return made


def _with_runs(line: Column, runs: Column, new) -> Column:
    """The line with every run replaced, from left to right; the text between stays."""

    def before(rest: Column, run: Column) -> Column:
        return F.call_function("substring_index", rest, run, F.lit(1))

    done = F.aggregate(
        runs, F.struct(F.lit("").alias("out"), line.alias("rest")),
        lambda s, run: F.struct(
            F.concat(s["out"], before(s["rest"], run), new(run)).alias("out"),
            F.substr(s["rest"], F.length(before(s["rest"], run)) + F.length(run) + 1).alias("rest"),
        ),
        lambda s: F.concat(s["out"], s["rest"]),
    )
    return F.when(F.size(runs) > 0, done).otherwise(line)


def shifted_decode(line: Column, markers: tuple[str, ...] = SHIFTED_MARKERS) -> Column:
    """Runs of eight or more characters that a font set 29 code points down, if they hold one of the
    markers, are moved up again and put in brackets. A capital word that happens to hold a marker
    is decoded too, as there is no telling it from such a run."""
    runs = F.regexp_extract_all(line, F.lit(r"[!-\]¿-Â]{8,}"), F.lit(0))
    held = "|".join(markers)
    return _with_runs(line, F.filter(runs, lambda r: r.rlike(held)), lambda r: F.concat(F.lit("⟨"), _unshifted(r), F.lit("⟩")))


def shifted_spaces_decode(line: Column) -> Column:
    """Runs around a U+0003, which is a space set 29 code points down, moved up again."""
    runs = F.regexp_extract_all(line, F.lit(r"[\x{03}!-\]¿-Â]*\x{03}[\x{03}!-\]¿-Â]*"), F.lit(0))
    return _with_runs(line, runs, _unshifted)


def letter_shares(text: Column) -> tuple[Column, Column]:
    """The shares of letters among what isn't white space, and of lower case among letters."""
    full = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    lower = F.length(F.regexp_replace(text, r"[^\p{Ll}]", ""))
    return letters / F.nullif(full, F.lit(0)), lower / F.nullif(letters, F.lit(0))


def is_garbled(text: Column) -> Column:
    """Under 60 % letters, under 60 % of them lower case, none at all, or a U+0003."""
    letters, lower = letter_shares(text)
    return F.coalesce((letters < 0.6) | (lower < 0.6), F.lit(True)) | F.contains(text, F.lit("\x03"))


def is_readable_font(text: Column) -> Column:
    """At least 20 characters, half of them lower-case letters or spaces."""
    good = F.length(F.regexp_replace(text, r"[^\p{Ll} ]", ""))
    return (F.length(text) >= 20) & (good * 2 >= F.length(text))


def dehyphenate(lines: Column) -> Column:
    """An array of lines as one: blank lines dropped, white space made single; a hyphen at a line's
    end goes if the next line starts in lower case and its first word has no hyphen, else it stays
    and a space follows."""
    bare = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")

    def join(done: Column, line: Column) -> Column:
        mends = done.endswith("-") & line.rlike(r"^\p{Ll}") & ~F.contains(F.split(line, " ")[0], F.lit("-"))
        return (
            F.when(done == "", line)
            .when(mends, F.concat(F.substr(done, F.lit(1), F.length(done) - 1), line))
            .otherwise(F.concat(done, F.lit(" "), line))
        )

    return F.aggregate(bare, F.lit(""), join)


def lines_of(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def indent_width(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))


def is_furniture(line: Column, patterns: list[str]) -> Column:
    """Whether the trimmed line matches one of the patterns as a whole."""
    return F.trim(line).rlike("^(?:" + "|".join(patterns) + ")$")


# Words that may be small in a term, and signs that may open one.
SMALL_WORDS = ["and", "of", "the", "a", "or", "to", "in", "de", "for", "at", "on", "&", "/"]
OPENS = r"^[\p{Lu}\p{Nd}“\"'(]"
NUMBERED = r"^[0-9]\.\s"


def looks_like_term(line: Column) -> Column:
    """Short, in title case and without a sentence's end: at most 40 characters, not numbered, an
    opening capital, digit, quote or bracket, and of up to three words in up to 25 characters one
    may be in lower case (small words don't count), else none."""
    text = F.trim(line)
    words = F.split(text, r"\s+")
    lower = F.size(F.filter(words, lambda w: ~w.rlike(OPENS) & ~F.lower(w).isin(SMALL_WORDS)))
    allowed = F.when((F.size(words) <= 3) & (F.length(text) <= 25), 1).otherwise(0)
    closed = text.rlike(r"[.,;:!?\"”’]$") | (text.endswith(")") & ~F.contains(text, F.lit("(")))
    short = (F.length(text) > 0) & (F.length(text) <= 40)
    return short & ~text.rlike(NUMBERED) & ~closed & text.rlike(OPENS) & (lower <= allowed)


def evidence_tags(text: Column) -> Column:
    """The classes of the tags [P], [R], [T] that aren't Markdown links, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[([PRT])\](?!\()"), F.lit(1))


#: A fenced code block, with both its fences.
FENCE = r"(?ms)^```.*?^```[^\n]*$"


def without_fences(text: Column) -> Column:
    """The text without its fenced code blocks."""
    return F.regexp_replace(text, FENCE, "")


def outside_fences(text: Column) -> Column:
    """The pieces of a text before, between and after its fenced code blocks. What stands on either
    side of a block is never read together."""
    return F.split(text, FENCE, -1)


def links(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r'href="(https?://[^"]+)"'), F.lit(1))


def page_url(path: Column, base: str) -> Column:
    """The address a page is published at: docs/ and .md go, index pages are their folder."""
    bare = F.regexp_replace(F.regexp_replace(path, "^docs/", ""), r"\.md$", "/")
    return F.concat(F.lit(base), F.regexp_replace(bare, "(^|/)index/$", "$1"))


def shows_actions(path: Column, front: Column) -> Column:
    """Whether a page shows its actions: not the home page, not those of about/, not one whose front
    matter says page_actions: false."""
    told = F.coalesce(F.lower(F.try_element_at(front, F.lit("page_actions"))), F.lit("true"))
    return (path != "index.md") & ~path.startswith("about/") & ~told.isin("false", "no", "off")


def archived_link(url: Column, direct: list[str], archive: str = "https://web.archive.org/web/2/") -> Column:
    """The link through the archive, unless its address starts with one of the prefixes or has
    one after a scheme."""
    bare = F.regexp_replace(url, "^[a-z]+://", "")
    stays = F.lit(False)
    for prefix in direct:
        stays = stays | bare.startswith(prefix) | F.contains(url, F.lit("://" + prefix))
    return F.when(stays, url).otherwise(F.concat(F.lit(archive), url))


def capture_of(url: Column) -> tuple[Column, Column]:
    """The time stamp (4 to 14 digits) and the original address of an archive's address."""
    pattern = r"^https?://web\.archive\.org/web/([0-9]{4,14})(?:id_)?/(.+)$"
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(url, pattern, 2), F.lit(""))


def format_citation(key: Column, locator: Column) -> Column:
    """[@key locator], the locator trimmed; empty without a key."""
    place = F.regexp_replace(F.coalesce(locator, F.lit("")), r"(?U)^\s+|\s+$", "")
    part = F.when(place == "", "").otherwise(F.concat(F.lit(" "), place))
    return F.when(F.coalesce(key, F.lit("")) == "", "").otherwise(F.concat(F.lit("[@"), key, part, F.lit("]")))


def entry_warnings(term: Column, definition: Column, longest_term: int = 40, longest_definition: int = 600) -> Column:
    """What a drafted entry should be looked at for; several may hold."""
    rules = (
        (F.coalesce(definition, F.lit("")) == "", "no definition"),
        (F.length(term) > longest_term, "long term"),
        (term.rlike(r"^\p{Ll}"), "term starts in lower case"),
        (term.rlike("[.,;:]$") & (F.length(term) > 3), "term ends in punctuation"),
        (F.length(definition) > longest_definition, "long definition"),
        (definition.rlike(r"^\p{Ll}"), "definition starts in lower case"),
    )
    return F.array_compact(F.array(*(F.when(holds, said) for holds, said in rules)))


def backoff(retry_after: Column, failures: Column, first: int = 60, most: int = 900) -> Column:
    """Seconds to wait after so many throttled answers in a row: as asked, if any time was asked (0 is
    none), else doubling."""
    return F.least(F.coalesce(F.nullif(retry_after, F.lit(0)), F.lit(first) * F.pow(F.lit(2.0), failures - 1)), F.lit(float(most)))
