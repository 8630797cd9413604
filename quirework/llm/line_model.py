"""A linear conditional model of page furniture: its features, its fit and its decoding.

The weights are fitted on all lines of the data at hand, from those that label themselves. Lines at a page's
edge that come back at other edges of their document, and lone page numbers there, are
furniture; lines inside a page that resemble no such line are body. All others are unlabelled: a
first fit, on how a line looks, says how likely each is furniture, and a second fit, which also
sees where a line stands and what comes back, takes that for its label. The weight of two
furniture lines beside each other is fitted with the rest, by pseudo-likelihood.

Where the lines say little the weights stay near their prior, so a handful of lines can be
labelled too.
"""

from __future__ import annotations

import numpy as np
import regex

#: How much the prior weighs: as a normal distribution of this precision around each weight.
PRECISION = 1.0

# How a line looks, and the prior of each weight: what a fit on scanned books came to, rounded.
LOOKS = {
    "number": 5.0, "numbered": 1.0, "titled": 0.3, "capital": -1.0, "upper": -0.3, "words_3": 1.3, "words_6": 0.8, "words_9": -4.0,
    "chars_25": 1.0, "chars_40": 0.8, "punctuation": -1.0, "hyphen": -0.5, "lower": -1.8, "interrupts": -0.5, "indent": -0.3,
    "gap_before": -1.0, "gap_after": 0.0, "head_words": 1.2, "body_words": 2.5,
}
# Where it stands, and what comes back.
PLACES = {"top": 0.2, "bottom": 0.5, "edge": 1.8, "near_edge": 1.6, "in_document": 3.0, "in_corpus": 1.2}
BIAS, BESIDE = -3.4, 0.5

ROMAN = r"(?=[ivxlcdm1!])m*(?:cm|cd|d?c{0,4})(?:xc|x[l1!i]|[l1!]?x{0,4})(?:[il1!]x|[il1!]v|v?[il1!]{0,4})"
AROUND = r"[\s\-–—=~*·•|\[\](){}_]*"
#: Patterns that both engines read alike.
NUMBER_LINE = rf"(?i)^{AROUND}(?:page\s+)?(?:[0-9]+|{ROMAN})(?:\s+of\s+[0-9]+)?{AROUND}$"
NUMBERED = rf"(?i)^(?:\[(?:[0-9]+|{ROMAN})\]\s+\S.*|.*\S\s*\|\s*(?:[0-9]+|{ROMAN})|(?:[0-9]+|{ROMAN})\s{{2,}}\S.*|.*\S\s{{2,}}(?:[0-9]+|{ROMAN}))$"
SMALL_WORD = r"(?:of|the|and|for|a|in|to)"
NOT_TITLED = rf"(?:^|\s)(?!{SMALL_WORD}(?:\s|$))\p{{Ll}}|[.;:!?]\s|,\s(?![0-9]+$)"
ENDS_SENTENCE, ENDS_HYPHEN, BEFORE_LAST_DIGIT = r"[.;:,!?]$", "[-‐‑¬\xad]$", "[0-9].$"
STARTS_LOWER = r"^(?![0-9\[])[^\p{L}]*\p{Ll}"


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, target: np.ndarray, prior: np.ndarray, rounds: int = 25, n: np.ndarray | float = 1.0) -> np.ndarray:
    """The most likely weights of a logistic model, given their prior; targets are probabilities.
    A row of x stands for n lines that are alike."""
    w = prior.copy()
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (n * (target - p)) - PRECISION * (w - prior)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


NAMES = ["bias", *LOOKS, *PLACES, "beside"]
PRIOR = np.array([BIAS, *LOOKS.values(), *PLACES.values(), BESIDE])


def shape_of(looks: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(looks), 1)), looks])


def features(looks: np.ndarray, places: np.ndarray, beside: np.ndarray) -> np.ndarray:
    return np.hstack([shape_of(looks), places, beside[:, None]])


def self_labelled(looks: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are furniture and which are body by themselves."""
    at = {name: k for k, name in enumerate(PLACES)}
    edge = (places[:, at["edge"]] > 0) | (places[:, at["near_edge"]] > 0)
    comes_back = places[:, at["in_document"]] > 0
    number = looks[:, list(LOOKS).index("number")] > 0
    return edge & (comes_back | number), ~edge & ~comes_back & (places[:, at["in_corpus"]] == 0)


def targets(looks: np.ndarray, places: np.ndarray, likely: np.ndarray) -> np.ndarray:
    furniture, body = self_labelled(looks, places)
    return np.where(furniture, 1.0, np.where(body, 0.0, likely))


def fit_looks(looks: np.ndarray, places: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first fit: the weights of the bias and of how a line looks, from lines that label themselves."""
    furniture, body = self_labelled(looks, places)
    labelled = furniture | body
    return fit(shape_of(looks)[labelled], furniture[labelled].astype(float), PRIOR[: 1 + looks.shape[1]], n=n[labelled])


def fit_lines(looks: np.ndarray, places: np.ndarray, pages: np.ndarray) -> dict[str, float]:
    """The weights by name, `bias` and `beside` among them, from lines in reading order; pages
    numbers the page of each line. No lines give the prior. scans.fitted does the same for
    lines that aren't in one place."""
    n = np.ones(len(looks))
    likely = sigmoid(shape_of(looks) @ fit_looks(looks, places, n))
    same = np.r_[False, pages[1:] == pages[:-1]][: len(looks)]
    weights = PRIOR
    for _ in range(2 if len(looks) else 0):
        target = targets(looks, places, likely)
        on = (target > 0.5).astype(float)
        beside = np.where(same, np.r_[0.0, on[:-1]], 0.0) + np.where(np.r_[same[1:], False], np.r_[on[1:], 0.0], 0.0)
        x = features(looks, places, beside)
        weights = fit(x, target, PRIOR)
        likely = sigmoid(x @ weights)
    return dict(zip(NAMES, weights.tolist()))


def decode(scores: list[float], beside: float) -> list[bool]:
    """The best labels of a page's lines, true for furniture. A score is a line's weight for
    furniture against body; beside is added where two furniture lines follow each other."""
    body, furniture = 0.0, -1e9
    came: list[tuple[bool, bool]] = []
    for score in scores:
        to_furniture = furniture + beside > body
        best = furniture + beside if to_furniture else body
        to_body = furniture > body
        came.append((to_body, to_furniture))
        body, furniture = max(body, furniture), best + score
    labels, state = [], furniture > body
    for to_body, to_furniture in reversed(came):
        labels.append(state)
        state = to_furniture if state else to_body
    return labels[::-1]


# ---- furniture inside a field ---------------------------------------------------------------------

_L = r"[\p{L}\p{N}]++(?:[@!'’][\p{L}\p{N}]++)*+@?"
_C = r"(?=[^\s\p{L}]*+\p{L})[\p{Lu}0][\p{L}\p{N}]*+(?:[@!][\p{L}\p{N}]++)*+@?"
_S = r"(?:(?:of|OF|the|THE|and|AND|for|FOR)\s+){0,2}"
#: Two to five words, all but the small ones with a capital; after an article the last may be small.
_TITLE = rf"(?:(?:A|The|THE)\s+{_S}{_C}(?:\s+{_S}{_C}){{0,2}}\s+{_S}{_L}|{_C}(?:\s+{_S}{_C}){{1,4}})"
#: A number beside a title, in the middle of a text.
SPAN = rf"(?<!\S)(?:\[[0-9]+\]|[0-9]+)\s+{_TITLE}(?![\p{{L}}\p{{N}}])|(?<!\S){_TITLE}\s+(?:\|\s*)?[0-9]+(?!\S)"
#: What every such span has, quick to look for: two words with a capital beside a number, or an
#: article and one such word.
_CAPITALS = r"[\p{Lu}0][^\s.,;:?]*+\s+(?:(?:of|OF|the|THE|and|AND|for|FOR)\s+){0,2}[\p{Lu}0]"
NEAR_SPAN = rf"[0-9]\]?\s+(?:{_CAPITALS}|The\s+(?:[a-z]+\s+){{0,2}}[\p{{Lu}}0])|{_CAPITALS}[^\s.,;:?]*+\s+(?:\|\s*)?[0-9]|\b(?:A|The|THE)\s+{_S}[\p{{Lu}}0]\S*\s+(?:\S+\s+){{1,8}}?(?:\|\s*)?[0-9]"
_FIRST_NUMBER = r"^(?:\[[0-9]+\]|[0-9]+)\s+|\s+(?:\|\s*)?[0-9]+$"

_compiled = {name: regex.compile(pattern) for name, pattern in {
    "number": NUMBER_LINE, "numbered": NUMBERED, "not_titled": NOT_TITLED, "sentence": ENDS_SENTENCE, "hyphen": ENDS_HYPHEN,
    "digit": BEFORE_LAST_DIGIT, "lower": STARTS_LOWER, "span": SPAN, "beside": _FIRST_NUMBER, "article": r"^(?:A|a|The|the|THE)\s+\p{Lu}", "last": r"\s\S+$",
}.items()}

#: Features of a line or span inside a field, with their priors.
PIECES = {
    "number": 6.0, "numbered": 2.0, "titled": 3.0, "words_3": 1.0, "words_6": 0.5, "words_9": -3.0,
    "punctuation": -3.0, "hyphen": -3.0, "lower": -3.0, "interrupts": 0.5,
}
PIECE_BIAS = -3.0
PIECE_PRIOR = [PIECE_BIAS, *PIECES.values()]
#: Texts of the sample that the fit for fields takes.
SAMPLED_TEXTS = 20_000


def piece_features(piece: str, before: str, after: str) -> list[float]:
    """The features of a line or span, given the text before and after it."""
    line = piece.strip()
    bare = _compiled["beside"].sub("", line)
    words = len(bare.split())
    title = bare
    if _compiled["article"].match(bare):
        title = _compiled["last"].sub("", bare)  # after an article the last word may be small
    number = bool(_compiled["number"].match(line)) and (any(c.isdigit() for c in line) or line.islower())
    before, after = before.rstrip(), after.lstrip()
    return [
        number, bare != line or bool(_compiled["numbered"].match(line)), not _compiled["not_titled"].search(title), words <= 3, 3 < words <= 6, words > 8,
        bool(_compiled["sentence"].search(line)) and not _compiled["digit"].search(line), bool(_compiled["hyphen"].search(line)), bool(_compiled["lower"].match(line)),
        bool(before and after and before[-1] not in ".!?:" and after[0].islower()),
    ]


def fit_pieces(texts: list[str]) -> list[float]:
    """Bias and weights for fields, from the lines inside the sampled texts: those that come back
    between different neighbours, and numbers, are furniture; short titles seen once are
    unlabelled; all others are body."""
    prior = np.array(PIECE_PRIOR)
    seen: dict[str, set] = {}
    rows = []
    for text in texts:
        lines = text.split("\n")
        for k in range(1, len(lines) - 1):
            if lines[k].strip():
                masked = regex.sub("[0-9]+", "#", lines[k].strip().lower())
                seen.setdefault(masked, set()).add((lines[k - 1][-12:], lines[k + 1][:12]))
                rows.append((masked, piece_features(lines[k], lines[k - 1], lines[k + 1])))
    if not rows:
        return prior.tolist()
    x = np.array([[1.0, *f] for _, f in rows], float)
    names = ["bias", *PIECES]
    column = lambda name: x[:, names.index(name)] > 0
    furniture = np.array([len(seen[m]) > 2 for m, _ in rows]) | column("number")
    unknown = ~furniture & column("titled") & (column("words_3") | column("words_6"))
    target = np.where(furniture, 1.0, np.where(unknown, sigmoid(x @ prior), 0.0))
    return fit(x, target, prior).tolist()


def furniture_spans(text: str, weights: list[float]) -> list[tuple[int, int]]:
    """Where a text has furniture inside it: whole lines (with the break after them) and spans."""
    score = lambda piece, before, after: weights[0] + sum(w for w, f in zip(weights[1:], piece_features(piece, before, after)) if f)
    found = []
    lines, at = text.split("\n"), 0
    alone = len(lines) == 1
    for k, line in enumerate(lines):
        end = at + len(line)
        if not alone and line.strip() and score(line, lines[k - 1] if k else "", lines[k + 1] if k + 1 < len(lines) else "") > 0:
            found.append((at, min(end + 1, len(text))) if k + 1 < len(lines) else (max(at - 1, 0), end))
        at = end + 1
    whole = list(found)
    start = 0
    while m := _compiled["span"].search(text, start):
        a, b = m.span()
        inside = any(x < b and a < y for x, y in whole)
        if not inside and score(m.group(), text[max(a - 40, 0) : a], text[b : b + 40]) > 0:
            found.append((a, b))
            start = b
        else:
            start = a + 1
    return sorted(found)
