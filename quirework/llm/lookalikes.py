"""Text that looks the same but is stored with other characters, brought to one form.

Every letter has the set of scripts in which something looks like it; a word's sets are
intersected. An empty native intersection is a mixed word, a native script other than Latin
whose letters all look Latin a whole-script confusable. Such a word is spelled in the script
that fits all its letters; compatibility forms, decomposed letters, spaces and invisible
characters are normalized.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that are taken for a Latin letter, from Unicode's public
# list of confusable characters: those of five scripts that look like a basic Latin letter in print.
CYRILLIC = dict(zip("АВЕКМНОРСТУХЅІЈҮԚԜӀавекмноресуохѕіјһԁԛԝѵүӏ", "ABEKMHOPCTYXSIJYQWIaBekMHopecyoxsijhdqwvyl"))
for _unlike in "вмн":  # these look like small capitals, not like letters in use
    del CYRILLIC[_unlike]
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαγικνορυχϲ", "ABEZHIKMNOPTYXCjayikvopuxc"))
ARMENIAN = dict(zip("ՍՕՏՈհոսօցյ", "UOSnhnuogj"))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiyAJEWMHYGhZbRWSVSLCPKdGB"))
COPTIC = dict(zip("ⲎⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ", "HKMNOoPpCcTYX"))
TO_LATIN = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | COPTIC
#: script -> Latin letter -> the letter of that script that looks like it
FROM_LATIN = {
    "CYRILLIC": {v: k for k, v in CYRILLIC.items()},
    "GREEK": {v: k for k, v in GREEK.items()},
    "ARMENIAN": {v: k for k, v in ARMENIAN.items()},
    "CHEROKEE": {v: k for k, v in CHEROKEE.items()},
    "COPTIC": {v: k for k, v in COPTIC.items()},
}

#: Decompositions that look like what they stand for; raised, lowered, circled and squared forms
#: and fractions don't.
ALIKE = ("<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")

#: Letters with the marks on them.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_SCRIPTS = {name: regex.compile(rf"\p{{Script={name}}}") for name in ("LATIN", *FROM_LATIN)}
_native: dict[str, str] = {}


def native(char: str) -> str:
    """A letter's script by its Script property; for scripts without look-alikes here the first
    word of its name will do."""
    found = _native.get(char)
    if found is None:
        known = (name for name, pattern in _SCRIPTS.items() if pattern.match(char))
        found = _native[char] = next(known, None) or unicodedata.name(char, "?").partition(" ")[0]
    return found


def scripts(char: str) -> frozenset[str]:
    """The scripts in which something looks like a letter."""
    mine = native(char)
    found = {mine}
    if char in TO_LATIN:
        found.add("LATIN")
        found.update(s for s, back in FROM_LATIN.items() if TO_LATIN[char] in back)
    elif mine == "LATIN":
        found.update(s for s, back in FROM_LATIN.items() if char in back)
    return frozenset(found)


def _compatible(char: str) -> str | None:
    """What a compatibility form stands for, None for other characters."""
    kind = unicodedata.decomposition(char)
    if kind.startswith(ALIKE):
        made = unicodedata.normalize("NFKC", char)
        # dots, primes and spacing accents are typography of their own
        return made if all(unicodedata.category(c)[0] in "LN" for c in made) or kind.startswith(("<wide>", "<narrow>", "<font>")) else None
    if kind and " " not in kind and unicodedata.normalize("NFC", char) != char:
        return unicodedata.normalize("NFC", char)
    return None


def _invisible(char: str) -> bool:
    return unicodedata.category(char) == "Cf" or char in "͏ᅟᅠㅤﾠ឴឵᠋᠌᠍" or "︀" <= char <= "️"


_CLASS: dict[str, tuple[str, str | None]] = {}


def _class(char: str) -> tuple[str, str | None]:
    found = _CLASS.get(char)
    if found is None:
        made = _compatible(char)
        if _invisible(char):
            found = ("invisible", "")
        elif unicodedata.category(char) in ("Zs", "Zl", "Zp") and char != " ":
            found = ("space", " ")
        elif made is not None:
            found = ("compatibility", made)
        else:
            found = ("", None)
        _CLASS[char] = found
    return found


def normalize(text: str | None) -> tuple[str | None, list[str]]:
    """The consistent form of a text and the kinds of change: invisible, space, compatibility,
    decomposed, lookalike. Only the form that looks the same is chosen: typographic quotes and
    dashes, marks without a composed letter and words of another script stay.

    Rounds of one_form until nothing changes, so a consistent form is its own: a letter that was
    spelled anew may compose with its mark or make its neighbours' script clear. A round leaves
    fewer letters that can be spelled, composed or replaced, so they end.
    """
    found: set[str] = set()
    while True:
        made, kinds = one_form(text)
        found.update(kinds)
        if made == text:
            return made, sorted(found)
        text = made


def one_form(text: str | None) -> tuple[str | None, list[str]]:
    """One round of normalize."""
    if not text or text.isascii():
        return text, []
    kinds = set()
    out = []
    for char in text:
        if char < "\x7f":
            out.append(char)
            continue
        kind, made = _class(char)
        if kind:
            kinds.add(kind)
            out.append(made)
        else:
            out.append(char)
    plain = "".join(out)
    composed = unicodedata.normalize("NFC", plain)
    if len(composed) < len(plain) or (composed != plain and unicodedata.normalize("NFD", plain) != plain):
        kinds.add("decomposed")
    found = list(_WORD.finditer(composed))
    spelled, at = [], 0
    for k, m in enumerate(found):
        word = m.group()
        if word.isascii():
            continue
        around = [found[j].group() for j in (k - 1, k + 1) if 0 <= j < len(found)]
        new, case = spell(word, around)
        if new != word:
            spelled.append(composed[at : m.start()] + new)
            at = m.end()
        if case:
            kinds.add("lookalike")
    whole = "".join([*spelled, composed[at:]])
    return unicodedata.normalize("NFC", whole) if spelled else whole, sorted(kinds)


def spell(word: str, around: list[str] = ()) -> tuple[str, bool]:
    """The word in the one script that fits it, and whether a letter of another script stood for
    a Latin one. around: the words beside it; a word whose letters all look Latin stays if one
    beside it is truly in its script."""
    letters = [c for c in word if unicodedata.category(c)[0] == "L"]
    own = {native(c) for c in letters}
    if own == {"LATIN"} or not letters:
        return word, False
    fits = frozenset.intersection(*(scripts(c) for c in letters))
    if len(own) == 1:
        mine = next(iter(own))
        if "LATIN" not in fits:
            return word, False
        for other in around:
            theirs = [c for c in other if unicodedata.category(c)[0] == "L"]
            if any(native(c) == mine for c in theirs) and "LATIN" not in frozenset.intersection(*(scripts(c) for c in theirs)):
                return word, False
        return "".join(TO_LATIN.get(c, c) for c in word), True
    if "LATIN" in fits:
        return "".join(TO_LATIN.get(c, c) for c in word), True
    for script in sorted(fits):
        if script in FROM_LATIN:
            back = FROM_LATIN[script]
            return "".join(c if native(c) == script else back.get(TO_LATIN.get(c, c), c) for c in word), False
    # no one script fits: the letters that can be Latin become it, if Latin is the word's own
    if "LATIN" in own:
        return "".join(TO_LATIN.get(c, c) for c in word), any(c in TO_LATIN for c in word)
    return word, False


RESULT = "text string, kinds array<string>"


def normalized(column: Column) -> Column:
    """Struct of the consistent text and the kinds of change. Null for null; ASCII doesn't reach
    Python."""

    @F.pandas_udf(RESULT)
    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normalize(t) if t is not None else (None, None) for t in texts], columns=["text", "kinds"])

    other = column.rlike(r"[^\x{00}-\x{7E}]")
    made = each(F.when(other, column))
    same = F.struct(column.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(other, made).when(column.isNotNull(), same)


def normalized_fields(rows: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """row_id, field_name, text (the consistent form) and kinds, for every field that isn't null.
    Repeated rows repeat; an empty table gives none; other columns aren't read. No shuffle."""
    long = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields)))
    each = rows.select(row_id, long.alias("f")).select(row_id, "f.field_name", "f.raw").where("raw is not null")
    return each.withColumn("made", normalized(F.col("raw"))).select(row_id, "field_name", "made.text", "made.kinds")
