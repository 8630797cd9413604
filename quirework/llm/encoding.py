"""Garbled text from wrong decoding: best-first search for the cheapest text that encode,
decode and unescape operations reach.

A state is a text or the bytes of one; states are visited once, by their hash. The cost of a
text is the sum over its non-ASCII characters of how odd each is between its neighbours. Lines
are searched first, then sentences, words and single runs, so that a garbled piece is found
beside text that was decoded well.
"""

from __future__ import annotations

import functools
import heapq
import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A character this odd makes its line worth a search.
ODD = 1.2
#: The average oddness of a text that is taken as it is.
SETTLED = 0.8
#: What a restored piece must save, and the price of each pair of operations.
MARGIN, STEP = 1.5, 0.4
#: Operations in a row: a text that was decoded wrongly more than three times isn't restored.
MOST_STEPS = 6
#: How much dearer a text on the way may be than the one before, and than the best so far.
DEARER, FARTHER = 1.0, 15.0

# How usual signs stand. Quotes that open and close, signs that stand free.
OPENING = "“‘„‚«¿¡‹"
CLOSING = "”»›"
CURRENCY = "£€¥"
LONE_MARKS = "†‡•‰§¶·¨´¸¯˜ˆ˘˝˙˚˛"
RARE_QUOTES = "‹›‚„"
DASHES = "–—―"
RARE_LETTERS = "ƒªºⁿıŸþÞðÐµ"
VOWELS = "аеёиоуыэюяіїє"
RARE_CYRILLIC = "ЂЃЅІЇЈЉЊЋЌЎЏђѓѕіїјљњћќўџґҐєЄ"

ENCODERS = ("sloppy-1252", "latin-1", "mac_roman", "cp437", "cp1251", "koi8_r", "cp850", "cp866")
DECODERS = ("utf-8", "sloppy-1252", "cp1251", "mac_roman", "cp437", "koi8_r", "cp850", "cp866")

#: How unusual it is that a text's true encoding is this; others 0.5.
RARITY = {"utf-8": 0.0, "unescape": 0.0, "sloppy-1252": 0.2, "cp1251": 0.2}

#: windows-1252 whose five undefined bytes are the control characters of that number
_TO_1252: dict[int, int] = {}
_FROM_1252: dict[int, int] = {}
for _byte in range(0x80, 0xA0):
    try:
        _char = ord(bytes([_byte]).decode("cp1252"))
    except UnicodeDecodeError:
        continue
    _TO_1252[_char], _FROM_1252[_byte] = _byte, _char
    _TO_1252[_byte] = 0x110000 - 1  # these controls have no byte of their own here

_scripts: dict[str, str] = {}


def script(char: str) -> str:
    """The first word of a letter's Unicode name, which is its script; empty for others."""
    found = _scripts.get(char)
    if found is None:
        found = ""
        if char and unicodedata.category(char)[0] == "L":
            found = unicodedata.name(char, "?").partition(" ")[0]
            if char in "ªºµ":
                found = "SIGN"
        _scripts[char] = found
    return found


def encode(text: str, name: str) -> bytes | None:
    try:
        if name == "sloppy-1252":
            return text.translate(_TO_1252).encode("latin-1")
        return text.encode(name)
    except UnicodeEncodeError:
        return None


def decode(data: bytes, name: str) -> str | None:
    try:
        if name == "sloppy-1252":
            return data.decode("latin-1").translate(_FROM_1252)
        return data.decode(name)
    except UnicodeDecodeError:
        return None


def _oddness(before: str, char: str, after: str) -> float:
    code, kind = ord(char), unicodedata.category(char)
    letters = before.isalpha() + after.isalpha()
    if char == "�" or kind in ("Cc", "Co", "Cn", "Cs"):
        return 8.0
    if char in "­​‌‍﻿":
        return 2.0 if char == "­" and before in "ÃÂ" else 0.5
    if kind[0] == "L":
        cost = 0.6
        mine = script(char)
        if mine in ("CYRILLIC", "GREEK"):
            cost = 0.3 + 1.2 * (char in RARE_CYRILLIC)
            if mine == "CYRILLIC":
                around = [c.lower() in VOWELS for c in (before, char, after) if script(c) == mine and c not in "ьъЬЪ"]
                like = len(around) == 3 and len({*around}) == 1
                cost += like * (0.9 if char.isupper() and before.isupper() else 0.8)
        elif mine not in ("LATIN", "SIGN"):
            cost = 1.0
        elif code > 0x17F:
            cost = 1.6
        if char in RARE_LETTERS:
            cost += 1.0
        if "ﬀ" <= char <= "ﬆ":
            cost += 1.0
        for other in (before, after):
            theirs = script(other)
            if theirs and theirs != mine:
                cost += 4.0
            elif theirs and ord(other) > 127 and mine == "LATIN":
                cost += 0.4
        if char.isupper() and before.islower():
            cost += 3.0
        elif char.isupper() and before.isupper() and after.islower() or char == "ß" and not before.isalpha():
            cost += 2.0
        elif char.islower() and before.isupper() and after.isupper():
            cost += 2.0
        if not letters and mine in ("CYRILLIC", "GREEK"):
            cost += 0.8
        elif not letters and char.islower() and mine == "LATIN":
            cost += 0.5
        if before.isdigit() and mine in ("LATIN", "GREEK"):
            cost += 1.5
        if before and before in ",.;":
            cost += 1.6
        elif (before == "" or before.isspace()) and after.isspace() and char.isupper() and mine == "LATIN":
            cost += 0.4
        return cost
    if kind[0] == "M":
        composed = len(unicodedata.normalize("NFC", before + char)) == 1
        return (1.0 if composed else 2.0) if before.isalpha() else 3.0
    if 0x2500 <= code <= 0x259F:
        return 4.0
    if char == "°":
        return 0.3 if (before.isdigit() or before == " ") and not after.islower() else 3.0
    if char in "±×÷":
        return 4.0 if letters == 2 else 2.5 if letters else 0.3
    if char in CURRENCY:
        return 0.3 if after.isdigit() and not before.isalpha() or before.isdigit() and not letters else 3.0
    if char == "¢":
        return 0.3 if before.isdigit() and not after.isalpha() else 3.0
    if char in "©®™":
        return 0.8 if not after.isalpha() and not (before.isalpha() and ord(before) > 127) else 3.5
    if kind == "No":
        return 3.0 if letters else 0.5
    if kind[0] == "S" or char in LONE_MARKS:
        return (4.0 if letters == 2 else 3.0 if letters else 2.0) if char not in LONE_MARKS or letters else 1.0
    if char == "’":
        return 0.2 if before and not before.isspace() else 0.6
    if char in RARE_QUOTES and letters < 2:
        return 1.0
    if char in OPENING:
        opens = before == "" or before.isspace() or before in "([{—–“‘-/\"'*_"
        return (0.8 if char in "¿¡" else 0.3) if opens and after != "" and not after.isspace() else 3.0
    if char in CLOSING:
        return 0.3 if before and not before.isspace() and not after.isalpha() else 3.0
    if char in DASHES:
        if letters == 2:
            return 0.9 if char == "—" else 2.0
        return 0.3 if not (before.isalpha() and ord(before) > 127) else 0.6
    if char == "…":
        return 0.3 if not after.isalpha() and not (before.isalpha() and ord(before) > 127) else 2.5
    if kind == "Zs":
        return 0.4 if not (before.isalpha() and ord(before) > 127) else 0.9
    return 0.8


_costs: dict[tuple[str, str, str], float] = {}
_OUTSIDE = re.compile(r"[^\x00-\x7f]")


def _each(text: str) -> Iterator[float]:
    for found in _OUTSIDE.finditer(text):
        at = found.start()
        key = (text[at - 1] if at else "", text[at], text[at + 1 : at + 2])
        cost = _costs.get(key)
        if cost is None:
            if len(_costs) > 200_000:
                _costs.clear()
            cost = _costs[key] = _oddness(*key)
        yield cost


def cost(text: str) -> float:
    """How implausible a text's characters are; 0 for ASCII."""
    return sum(_each(text))


def odd(text: str) -> bool:
    return any(c >= ODD for c in _each(text))


_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_CUT = "\x1f"


def _contexts(text: str) -> list[tuple[str, str, str]]:
    """The distinct non-ASCII runs, each with the character before and after."""
    found = {}
    for m in _NON_ASCII.finditer(text):
        found[text[m.start() - 1 : m.start()], m.group(), text[m.end() : m.end() + 1]] = None
    return list(found)


Chain = tuple[str, ...]


def restore(text: str) -> tuple[str, float, Chain]:
    """The cheapest text within reach, what it saves and the operations that lead to it; the text
    itself, 0 and no operations if none is.

    The operations leave ASCII as it is, so the search runs on the distinct non-ASCII runs
    alone, and what it finds is put back for each.
    """
    contexts = _contexts(text)
    if "&" in text or _CUT in text or not contexts:
        return search(text)
    short = _CUT.join("".join(c) for c in contexts)
    found, saved, chain = search(short)
    if not saved:
        return text, 0.0, ()
    new = {c: piece[len(c[0]) : len(piece) - len(c[2])] for c, piece in zip(contexts, found.split(_CUT))}
    return _NON_ASCII.sub(lambda m: new[text[m.start() - 1 : m.start()], m.group(), text[m.end() : m.end() + 1]], text), saved, chain


def apply(chain: Chain, text: str) -> str | None:
    """The text after the chain's operations; None if one of them can't be applied to it."""
    state: str | bytes | None = text
    for name in chain:
        state = html.unescape(state) if name == "unescape" else encode(state, name) if isinstance(state, str) else decode(state, name)
        if state is None:
            return None
    return state


def certain(chain: Chain) -> bool:
    """Whether the chain's last reading proves itself: hardly any text is valid UTF-8 by chance."""
    return bool(chain) and chain[-1] == "utf-8"


def settled(text: str) -> bool:
    """Whether nothing in a text is odd and its characters stand as usual on the whole."""
    costs = list(_each(text))
    return all(c < ODD for c in costs) and sum(costs) <= SETTLED * len(costs)


def ambiguous(text: str, best: str) -> bool:
    """Whether another single reading of a text leaves nothing odd either."""
    for name in ENCODERS:
        data = encode(text, name)
        for other in DECODERS if data is not None else ():
            made = decode(data, other)
            if made is not None and made not in (text, best) and not odd(made) and plausible(made):
                return True
    return False


@functools.lru_cache(50_000)
def search(text: str) -> tuple[str, float, Chain]:
    """Best first over all texts that MOST_STEPS operations reach by way of none that is much
    dearer; every text and every string of bytes is visited once."""
    start = cost(text)
    best, best_cost, best_chain = text, start, ()
    heap: list[tuple[float, int, float, str | bytes, Chain]] = [(start, 0, start, text, ())]
    visited = {hash(text)}
    order = 0
    while heap:
        total, _, plain, state, chain = heapq.heappop(heap)
        if isinstance(state, str):
            if total < best_cost:
                best, best_cost, best_chain = state, total, chain
                if chain and not odd(state):
                    break
            if len(chain) >= MOST_STEPS or plain < 0.3 or total > best_cost + FARTHER:
                continue
            reached = [(data, name) for name in ENCODERS if (data := encode(state, name)) is not None]
            if "&" in state:
                reached.append((html.unescape(state), "unescape"))
        else:
            reached = [(made, name) for name in DECODERS if name != chain[-1] and (made := decode(state, name)) is not None]
        for new, name in reached:
            seen = hash((new, name) if isinstance(new, bytes) else new)
            if seen in visited:
                continue
            visited.add(seen)
            price = cost(new) if isinstance(new, str) else plain
            if price <= plain + DEARER:
                order += 1
                paid = (len(chain) + 1) * STEP / 2 + RARITY.get(name, 0.5) * isinstance(new, str)
                # bytes have no look: they are decoded before any text is chosen
                first = -1000 * isinstance(new, bytes)
                heapq.heappush(heap, (price + paid + first, order, price, new, (*chain, name)))
    saved = start - best_cost
    return (best, saved, best_chain) if saved >= MARGIN else (text, 0.0, ())


_SENTENCE = re.compile(r"(?<=[.!?])(\s+)")
_SPACE = re.compile(r"([ \t]+)")
_RUN = re.compile(r"([^\x00-\x7f]+)")
#: Text decoded wrongly more than once has lost its own line ends and sentences at most there.
_LEVELS = (re.compile(r"(\n)"), _SENTENCE, _SPACE, _RUN)


def _suspect(text: str) -> bool:
    return odd(text) or ("&" in text and odd(html.unescape(text)))


def _repair(text: str, level: int) -> tuple[str, int, bool]:
    """The text with its garbled pieces restored, how many pieces were, and whether all of them
    were restored for certain or into plausible text.

    A reading that leaves nothing odd holds for the whole piece, and so does one that proves itself
    (UTF-8): what is odd in it afterwards is searched from there, not from the garbled text again.
    Any other reading gives way to smaller pieces that come out cheaper together.
    """
    if not _suspect(text):
        return text, 0, True
    if not odd(text):
        # entities hide the garbled characters; if nothing comes of them they stay
        made, n, sure = _repair(html.unescape(text), level)
        return (made, n, sure) if n else (text, 0, True)
    best, saved, chain = restore(text)
    sure = certain(chain) or bool(saved) and not odd(best) and plausible(best) and not ambiguous(text, best)
    if saved and (not any(c < ODD for c in _each(text)) or settled(best)):
        return best, 1, sure
    # some characters look right as they are: smaller pieces may do better
    if level < len(_LEVELS):
        base = best if certain(chain) else text
        done = _pieces(_LEVELS[level].split(base), level)
        n = sum(k for _, k, _ in done)
        joined = "".join(p for p, _, _ in done)
        if n and cost(joined) < cost(best) - 0.05:
            return joined, n + certain(chain), all(s for _, k, s in done if k)
    return (best, 1, sure) if saved else (text, 0, not odd(text))


def _pieces(pieces: list[str], level: int) -> list[tuple[str, int, bool]]:
    """The pieces, each restored. The reading that saves most over all pieces holds for every piece
    that can be read so, if it proves itself or gives the letters of another alphabet: words of a
    letter or two would fit many readings alone, or look right as they are."""
    done = [_repair(p, level + 1) if p else (p, 0, True) for p in pieces]
    worth: dict[Chain, list[float]] = {}
    for piece in pieces:
        if piece and odd(piece):
            _, saved, chain = restore(piece)
            if chain:
                worth.setdefault(chain, []).append(saved)
    if not worth:
        return done
    chain = max(worth, key=lambda c: (sum(worth[c]), c))
    out, doubtful = [], False
    for piece, found in zip(pieces, done):
        made = apply(chain, piece) if piece and not piece.isascii() else None
        # a piece that can be read so too, but isn't
        doubtful |= made is not None and made not in (piece, found[0]) and not odd(made)
        other = made is not None and all(script(c) == "CYRILLIC" for c in made if c > "\x7f")
        holds = made is not None and made != piece and not odd(made) and (certain(chain) or other and len(worth[chain]) > 1)
        out.append((made, 1, certain(chain) or plausible(made)) if holds else found)
    doubtful |= len(worth) > 1 and not certain(chain)
    return [(piece, k, sure and not doubtful) for piece, k, sure in out] if doubtful and not certain(chain) else out


_CYRILLIC = re.compile(r"[\u0400-\u04ff]+")
_CLUSTER = re.compile(r"[бвгджзклмнпрстфхцчшщ]{4,}|([аеёиоуыэюя])\1", re.I)


def plausible(text: str) -> bool:
    """Whether a text that no encoding proves reads like one: its words in another alphabet have
    vowels and no heaps of consonants or doubled vowels, capitals only at their start or
    throughout, and no letter of a third alphabet beside them. Strict: a real word may fail."""
    for m in _CYRILLIC.finditer(text):
        word = m.group()
        if len(word) > 3 and not any(c in VOWELS for c in word.lower()) or _CLUSTER.search(word) or not (word.islower() or word.isupper() or word.istitle()):
            return False
    return not any(script(c) not in ("LATIN", "CYRILLIC", "") for c in text)


def repair(text: str | None) -> tuple[str | None, int, bool]:
    """The text with what can be restored, the number of restored pieces and whether it may still
    be wrong: signs of wrong decoding are left (replacement or control characters, odd ones), or a
    piece was restored by a reading that neither proves itself nor gives plausible text."""
    if not text or (text.isascii() and "&" not in text):
        return text, 0, False
    done, n, sure = [], 0, True
    for line in _LEVELS[0].split(text):
        new, k, certainly = _repair(line, 1)
        done.append(new)
        n += k
        sure &= certainly or not k
    made = "".join(done)
    return made, n, bool(_LEFT.search(made)) or bool(n) and (not sure or odd(made) or bool(_CONTROLS.search(made)))


_CONTROLS = re.compile("[\x00-\x08\x0e-\x1f]")
_LEFT = re.compile("[�\x80-\x84\x86-\x9f]")


def garbled(documents: DataFrame, row_id: str, text: str) -> DataFrame:
    """The documents whose text was decoded wrongly somewhere: row_id, n_pieces restored,
    restored (the text as far as it can be restored) and complete (nothing odd is left, and each
    piece was read in a way that proves itself or gives plausible text). Texts that were read in
    an encoding that is not among ENCODERS, or written in one not among DECODERS, aren't restored;
    where one comes out cheaper all the same, it is rarely complete.

    Null, empty and plain ASCII texts are never garbled and don't reach Python. Each row is
    judged alone, whatever its length, so repeated rows repeat and there is no shuffle.
    """

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [(i, *repair(t)) for i, t in zip(frame["id"], frame["text"])]
            found = [(i, n, made, not left) for i, made, n, left in done if n or _LEFT.search(made or "")]
            yield pd.DataFrame(found, columns=["id", "n_pieces", "restored", "complete"])

    rows = documents.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    likely = rows.where(F.col("text").rlike(r"[^\x{00}-\x{7F}]|&#?[A-Za-z0-9]+;"))
    return likely.mapInPandas(search, "id bigint, n_pieces int, restored string, complete boolean").withColumnRenamed("id", row_id)
