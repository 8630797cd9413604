"""Citations that are resolved by rule: captures, dated issues, dated posts, pointers and items.

A rule is configuration: the key it is cited by, what kind it is, where it leads and how it is
named. A citation whose key has a rule is resolved by it; one whose key has none, or that a post's
rule does not fit, is looked up in the catalog. Everything is a projection; the only join is that
of issues with their dates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.operators.citations import PAGE, resolve
from quirework.operators.skew import small

KINDS = ("capture", "issue", "post", "pointer", "item")
# What a post's locator and a date look like; a page anywhere in a locator.
POST = r"(?s)^(\d{4})-(\d{2})-(\d{2})\s+([a-z0-9-]+)\s*([^\n]*)$"
POST_DATE = r"^(\d{4})-(\d{2})-(\d{2})$"
ANY_PAGE = r"p\.?\s*(\d+)"


@dataclass(frozen=True)
class Rule:
    """key: what it is cited by; kind: one of KINDS; base: the address it leads to or begins with;
    name: how its label ends or begins; title: what hovers, where that isn't the name."""

    key: str
    kind: str
    base: str
    name: str
    title: str | None = None


@dataclass(frozen=True)
class Place:
    """A locator taken apart: all of it, and its first words."""

    whole: Column
    words: Column

    def word(self, k: int) -> Column:
        """The k-th word from 0; the last of those split off is the rest. Null if there is none."""
        return F.nullif(F.get(self.words, F.lit(k)), F.lit(""))


def place_of(locator: Column, words: int) -> Place:
    whole = F.regexp_replace(F.coalesce(locator, F.lit("")), r"(?U)^\s+|\s+$", "")
    return Place(whole, F.split(whole, r"(?U)\s+", words))


def printed(day: Column) -> Column:
    """A date as 5 Oct 1984."""
    return F.date_format(day, "d MMM yyyy")


def _noted(label: Column, notes: Column) -> Column:
    return F.concat(label, F.coalesce(F.concat(F.lit(", "), notes), F.lit("")))


def _resolved(url: Column, label: Column, hover: Column) -> Column:
    return F.struct(url.alias("url"), label.alias("label"), hover.alias("hover_title"), F.lit(True).alias("found"))


def _bad(cited: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("url"), cited.alias("label"), F.lit("").alias("hover_title"), F.lit(False).alias("found"))


def capture(rule: Rule, locator: Column, cited: Column) -> Column:
    """`stamp address notes`: the capture of that time; bad without both."""
    place = place_of(locator, 3)
    stamp, address = place.word(0), place.word(1)
    day = F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2))
    short = F.regexp_replace(address, r"^https?://(www\.)?", "")
    label = F.concat(_noted(F.concat(short, F.lit(", archived "), day), place.word(2)), F.lit(f" ({rule.name})"))
    hover = F.concat(F.lit(f"{rule.title or rule.name} capture of "), address, F.lit(" on "), stamp)
    return F.when(address.isNull(), _bad(cited)).otherwise(_resolved(F.concat(F.lit(rule.base), stamp, F.lit("/"), address), label, hover))


def issue(rule: Rule, locator: Column, cited: Column, issued: Column) -> Column:
    """`id notes`: an issue, at the page that the notes name, with its date if that is known; bad
    without an id."""
    place = place_of(locator, 2)
    number, notes = place.word(0), place.word(1)
    page = F.nullif(F.regexp_extract(F.coalesce(notes, F.lit("")), PAGE, 1), F.lit(""))
    url = F.concat(F.lit(rule.base), number, F.lit("/"), F.coalesce(F.concat(F.lit("m1/"), page, F.lit("/")), F.lit("")))
    label = _noted(_noted(F.lit(rule.name), printed(issued)), notes)
    where = rule.title or rule.name
    return F.when(number.isNull(), _bad(cited)).otherwise(_resolved(url, F.concat(label, F.lit(f" ({where})")), F.concat(F.lit(f"{where}, "), number)))


def post(rule: Rule, locator: Column, cited: Column) -> Column:
    """`yyyy-mm-dd slug notes`: a post; null, for the catalog, if the locator isn't one."""
    whole = place_of(locator, 1).whole
    year, month, day, slug, notes = (F.regexp_extract(whole, POST, k) for k in range(1, 6))
    date = F.concat_ws("-", year, month, day)
    url = F.concat(F.lit(rule.base), F.concat_ws("/", year, month, day, slug), F.lit("/"))
    made = _resolved(url, _noted(F.concat(F.lit(f"{rule.name}, "), date), F.nullif(notes, F.lit(""))), F.concat(F.lit(f"{rule.name} post "), slug, F.lit(" ("), date, F.lit(")")))
    return F.when(whole.rlike(POST), made)


def pointer(rule: Rule, locator: Column, cited: Column) -> Column:
    """An archive's home page, labelled with the place there."""
    return _resolved(F.lit(rule.base), F.concat(F.lit(f"{rule.name}, "), place_of(locator, 1).whole), F.lit(rule.title or rule.name))


def item(rule: Rule, locator: Column, cited: Column) -> Column:
    """`address label`: an item at an absolute address or one within the base; bad without one."""
    place = place_of(locator, 2)
    address = place.word(0)
    url = F.when(address.startswith("http"), address).otherwise(F.concat(F.lit(rule.base), F.ltrim(address, F.lit("/"))))
    label = F.concat(F.coalesce(place.word(1), F.lit(f"{rule.title or rule.name} item")), F.lit(f" ({rule.name})"))
    return F.when(address.isNull(), _bad(cited)).otherwise(_resolved(url, label, F.lit(rule.title or rule.name)))


def resolve_all(citations: DataFrame, catalog: DataFrame, rules: Sequence[Rule], issues: DataFrame, key: str = "cite_key", locator: str = "locator") -> DataFrame:
    """citations with url, label, hover_title and found: by the rule of their key, else by the
    catalog. issues has paper and issued (a date), one row a paper.

    A malformed citation is kept, not found, and labelled with itself. Null and empty keys have no
    rule. Columns of citations that are named like the results are replaced.
    """
    by_catalog = resolve(citations, catalog, key, locator)
    place = F.coalesce(locator, F.lit(""))
    cited = F.concat(F.lit("[@"), F.col(key), F.when(place.rlike(r"^(?U)\s|^$"), place).otherwise(F.concat(F.lit(" "), place)), F.lit("]"))
    first = place_of(F.col(locator), 2).word(0)
    dated = [r.key for r in rules if r.kind == "issue"]
    known = issues.select(F.col("paper").alias("_paper"), F.to_date("issued").alias("_issued"))
    rows = by_catalog.withColumn("_asked", F.when(F.col(key).isin(dated), first)).join(small(known), F.col("_asked") == F.col("_paper"), "left")
    made = F.lit(None)
    builders = {"capture": capture, "post": post, "pointer": pointer, "item": item}
    for rule in reversed(rules):
        by_rule = issue(rule, F.col(locator), cited, F.col("_issued")) if rule.kind == "issue" else builders[rule.kind](rule, F.col(locator), cited)
        made = F.when(F.col(key) == rule.key, by_rule).otherwise(made)
    rows = rows.withColumn("_made", made)
    results = ("url", "label", "hover_title", "found")
    pick = [F.when(F.col("_made").isNotNull(), F.col("_made")[c]).otherwise(F.col(c)).alias(c) for c in results]
    return rows.select(*(c for c in by_catalog.columns if c not in results), *pick)


def checked_targets(citations: DataFrame, rules: Sequence[Rule], key: str = "cite_key", locator: str = "locator") -> DataFrame:
    """citations with target, stamp and original: what a check of links would ask for. The check
    reads locators less strictly than the page does: a page number may stand anywhere and any second
    word is a slug. Only captures, issues and posts are checked; what misses a part is left out."""
    place = place_of(F.col(locator), 3)
    first, second = place.word(0), place.word(1)
    page = F.nullif(F.regexp_extract(F.coalesce(locator, F.lit("")), ANY_PAGE, 1), F.lit(""))
    target = stamp = original = F.lit(None).cast("string")
    for rule in rules:
        mine = F.col(key) == rule.key
        if rule.kind == "capture":
            whole = mine & second.isNotNull()
            stamp, original = F.when(whole, first).otherwise(stamp), F.when(whole, second).otherwise(original)
        elif rule.kind == "issue":
            address = F.concat(F.lit(rule.base), first, F.lit("/"), F.coalesce(F.concat(F.lit("m1/"), page, F.lit("/")), F.lit("")))
            target = F.when(mine & first.isNotNull(), address).otherwise(target)
        elif rule.kind == "post":
            address = F.concat(F.lit(rule.base), F.replace(first, F.lit("-"), F.lit("/")), F.lit("/"), second, F.lit("/"))
            target = F.when(mine & second.isNotNull() & first.rlike(POST_DATE), address).otherwise(target)
    made = citations.withColumns({"target": target, "stamp": stamp, "original": original})
    return made.where(F.col("target").isNotNull() | F.col("stamp").isNotNull())


@dataclass(frozen=True)
class Corpus:
    """Where the files of a corpus lie: the folders a path is counted from; sites whose pages are
    kept as text, with their address; the folder of yearly books and what they are cited by; the
    folder of posts, what they are cited by and where they are."""

    roots: tuple[str, ...]
    text_sites: dict[str, str]
    books: str
    book_key: str
    posts: str
    post_key: str
    post_base: str
    capture_key: str


def path_citation(path: Column, corpus: Corpus) -> Column:
    """The citation of a corpus file by the first rule that fits its path: a mirrored file
    (site/mirror/host/folders/stamp__name), a page kept as text (site/text/section__page__stamp.md),
    a yearly book, a post; else (no rule for path). Null gives null."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    for root in corpus.roots:
        path = F.regexp_replace(path, rf"^.*?{root}", "")
    group = lambda pattern, *ks: [F.regexp_extract(path, pattern, k) for k in ks]
    mirror = r"^([^/]+)/mirror/([^/]+)/(.*?)(\d{14})__([^/]+)$"
    host, folders, stamp, name = group(mirror, 2, 3, 4, 5)
    sites = "|".join(f"\\Q{s}\\E" for s in corpus.text_sites)
    text = rf"^({sites})/text/(.+?)__(\d{{14}})\.md$"
    site, page, taken = group(text, 1, 2, 3)
    bases = F.create_map(*(F.lit(x) for pair in corpus.text_sites.items() for x in pair))
    book = rf"^\Q{corpus.books}\E/(?:text(?:-raw)?/)?(\d{{4}})-\Q{corpus.book_key}\E"
    post_file = rf"^\Q{corpus.posts}\E/(\d{{4}})-(\d{{2}})-(\d{{2}})_(.+?)\.md$"
    year, month, day, slug = group(post_file, 1, 2, 3, 4)
    cite = f"[@{corpus.capture_key} "
    return (
        F.when(path.rlike(mirror), F.concat(F.lit(cite), stamp, F.lit(" http://"), host, F.lit("/"), folders, name, F.lit("]")))
        .when(path.rlike(text), F.concat(F.lit(cite), taken, F.lit(" "), F.try_element_at(bases, site), F.lit("/"), F.replace(page, F.lit("__"), F.lit("/")), F.lit("]")))
        .when(path.rlike(book), F.concat(F.lit(f"[@{corpus.book_key}-"), group(book, 1)[0], F.lit(" p.N]")))
        .when(path.rlike(post_file), F.concat(F.lit(f"[@{corpus.post_key} "), F.concat_ws("-", year, month, day), F.lit(" "), slug, F.lit("]  → " + corpus.post_base), F.concat_ws("/", year, month, day, slug), F.lit("/")))
        .when(path.isNotNull(), F.concat(F.lit("(no rule for "), path, F.lit(")")))
    )
