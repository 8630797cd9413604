"""Queries of citations that go by rule, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import catalog as K
from quirework.operators.citation_rules import Corpus, Rule, checked_targets, path_citation, resolve_all
from quirework.plans.records import issues
from quirework.sources.tables import table

#: Invented rules that stand for a configured table of them.
RULES = (
    Rule("cap", "capture", "https://captures.example/web/", "Capture Machine"),
    Rule("paper", "issue", "https://papers.example/id/", "Larkmoor Paper", "Portal of Papers"),
    Rule("blog", "post", "https://blog.example/", "Larkmoor Corner"),
    Rule("archive", "pointer", "https://archive.example/", "Larkmoor Archive", "Larkmoor Archive, Reading Room"),
    Rule("scans", "item", "https://scans.example/", "Scan Collections", "Library Scan Collections"),
)
CORPUS = Corpus(
    ("/corpus/", "larkmoor-archive/"), {"old.larkmoor.example": "http://old.larkmoor.example/pages", "www.larkmoor.example": "http://www.larkmoor.example/all"},
    "books.example/yearbooks", "yearbook", "corner.example/posts", "blog", "https://blog.example/", "cap",
)


def _cited(spark: SparkSession, folder: str) -> DataFrame:
    """Every citation under one of the rules' keys, some of them malformed."""
    rows = table(spark, folder, "resolved_citations")
    stamp = F.coalesce(F.date_format("resolved_at", "yyyyMMddHHmmss"), F.lit("20200101000000"))
    day = F.coalesce(F.date_format("resolved_at", "yyyy-MM-dd"), F.lit("2020-01-01"))
    place, kind, whole = F.coalesce("locator", F.lit("")), F.col("citation_id") % 6, F.col("citation_id") % 4 != 0
    key = F.element_at(F.array(*map(F.lit, ("cap", "paper", "blog", "archive", "scans", "blog"))), (kind + 1).cast("int"))
    locator = (
        F.when(kind == 0, F.when(whole, F.concat(F.lit("  "), stamp, F.lit("  https://www.site.example/"), F.coalesce("page", F.lit("")), F.lit(" "), place)).otherwise(stamp))
        .when(kind == 1, F.when(whole, F.concat(F.coalesce("cite_key", F.lit("none")), F.lit(" "), place)).otherwise(" "))
        .when(kind == 2, F.concat(day, F.lit(" a-post "), place))
        .when(kind == 3, place)
        .when(kind == 4, F.when(whole, F.concat(F.lit("/item/"), F.col("citation_id").cast("string"), F.lit(" "), place)).otherwise("http://other.example/x"))
        .otherwise(place)
    )
    return rows.select("citation_id", key.alias("cite_key"), locator.alias("locator"))


def citation_rules(spark: SparkSession, folder: str) -> DataFrame:
    made = resolve_all(_cited(spark, folder), K.load(table(spark, folder, "bibliography")), RULES, issues(spark, folder))
    return made.select("citation_id", "url", "label", "hover_title", "found")


def checker_targets(spark: SparkSession, folder: str) -> DataFrame:
    return checked_targets(_cited(spark, folder), RULES).select("citation_id", "target", "stamp", "original")


def path_to_citation(spark: SparkSession, folder: str) -> DataFrame:
    """The citation of a corpus file for every address of the catalog, laid out in four ways."""
    rows = table(spark, folder, "bibliography").where("url is not null")
    name = F.regexp_extract("url", r"([^/]*)$", 1)
    kind = F.col("row_ord") % 5
    path = (
        F.when(kind == 0, F.concat(F.lit("C:\\corpus\\".replace("C:", "/x")), F.lit("site\\mirror\\host.example\\a\\b\\20010203040506__"), name))
        .when(kind == 1, F.concat(F.lit("old.larkmoor.example/text/section__"), F.col("source_key"), F.lit(".html__20010203040506.md")))
        .when(kind == 2, F.concat(F.lit("/home/larkmoor-archive/books.example/yearbooks/text-raw/1987-yearbook-"), name))
        .when(kind == 3, F.concat(F.lit("corner.example/posts/2019-10-05_"), F.col("source_key"), F.lit(".md")))
        .otherwise(F.col("url"))
    )
    return rows.select("file_ord", "row_ord", path_citation(path, CORPUS).alias("citation"))


QUERIES = {f.__name__: f for f in (citation_rules, checker_targets, path_to_citation)}

_CITED = r"""
with catalog as (select * from (select *, row_number() over (partition by source_key order by file_ord desc nulls last, row_ord desc nulls last) as k from bibliography where source_key <> '') where k = 1),
raw as (select citation_id, ['cap', 'paper', 'blog', 'archive', 'scans', 'blog'][citation_id % 6 + 1] as key, citation_id % 6 as kind, citation_id % 4 <> 0 as whole, coalesce(locator, '') as place,
  coalesce(strftime(resolved_at, '%Y%m%d%H%M%S'), '20200101000000') as stamp, coalesce(strftime(resolved_at, '%Y-%m-%d'), '2020-01-01') as day, coalesce(page, '') as page, coalesce(cite_key, 'none') as ck from resolved_citations),
cited as (select citation_id, key, kind, case kind when 0 then case when whole then '  ' || stamp || '  https://www.site.example/' || page || ' ' || place else stamp end
  when 1 then case when whole then ck || ' ' || place else ' ' end when 2 then day || ' a-post ' || place when 4 then case when whole then '/item/' || citation_id || ' ' || place else 'http://other.example/x' end else place end as locator from raw),
words as (select *, trim(locator) as w, nullif(regexp_extract(trim(locator), '^(\S+)', 1), '') as one, nullif(regexp_extract(trim(locator), '^\S+\s+(\S+)', 1), '') as two,
  nullif(regexp_extract(trim(locator), '(?s)^\S+\s+(.*)$', 1), '') as rest, nullif(regexp_extract(trim(locator), '(?s)^\S+\s+\S+\s+(.*)$', 1), '') as last,
  '[@' || key || case when locator = '' or regexp_matches(locator, '^\s') then locator else ' ' || locator end || ']' as whole_text from cited)
"""

SQL = {
    "citation_rules": _CITED + r""", dated as (select paper, arg_max(issued, {'f': file_ord, 'r': row_ord}) as issued from (select source_key as paper, date_raw as issued, file_ord, row_ord from bibliography where starts_with(source_key, 'w') and regexp_full_match(date_raw, '\d{4}-\d{2}-\d{2}')) group by paper),
  j as (select w.*, cast(d.issued as date) as issued, regexp_extract(w.w, '^(\d{4}-\d{2}-\d{2})\s+([a-z0-9-]+)\s*([^\n]*)$', ['d', 's', 'n']) as p, nullif(regexp_extract(coalesce(rest, ''), '\bp\.?\s*(\d+)', 1), '') as pg
    from words w left join dated d on d.paper = w.one and w.kind = 1)
  select citation_id,
    case when kind = 0 and two is not null then 'https://captures.example/web/' || one || '/' || two when kind = 1 and one is not null then 'https://papers.example/id/' || one || '/' || coalesce('m1/' || pg || '/', '')
      when key = 'blog' and p.d <> '' then 'https://blog.example/' || replace(p.d, '-', '/') || '/' || p.s || '/' when kind = 3 then 'https://archive.example/' when kind = 4 and one is not null then case when starts_with(one, 'http') then one else 'https://scans.example/' || ltrim(one, '/') end end as url,
    case when kind = 0 then case when two is null then whole_text else regexp_replace(two, '^https?://(www\.)?', '') || ', archived ' || one[1:4] || '-' || one[5:6] || '-' || one[7:8] || coalesce(', ' || last, '') || ' (Capture Machine)' end
      when kind = 1 then case when one is null then whole_text else 'Larkmoor Paper' || coalesce(', ' || strftime(issued, '%-d %b %Y'), '') || coalesce(', ' || rest, '') || ' (Portal of Papers)' end
      when key = 'blog' then case when p.d <> '' then 'Larkmoor Corner, ' || p.d || coalesce(', ' || nullif(p.n, ''), '') else '[@blog' || case when w = '' then '' else ' ' || w end || '] (unknown source key)' end
      when kind = 3 then 'Larkmoor Archive, ' || w else case when one is null then whole_text else coalesce(rest, 'Library Scan Collections item') || ' (Scan Collections)' end end as label,
    case when kind = 0 then case when two is null then '' else 'Capture Machine capture of ' || two || ' on ' || one end when kind = 1 then case when one is null then '' else 'Portal of Papers, ' || one end
      when key = 'blog' then case when p.d <> '' then 'Larkmoor Corner post ' || p.s || ' (' || p.d || ')' else 'unknown source key' end when kind = 3 then 'Larkmoor Archive, Reading Room' else case when one is null then '' else 'Library Scan Collections' end end as hover_title,
    case when kind = 0 then two is not null when kind in (1, 4) then one is not null when key = 'blog' then p.d <> '' else true end as found from j""",
    "checker_targets": _CITED + r"""select citation_id, case when kind = 1 then 'https://papers.example/id/' || one || '/' || coalesce('m1/' || nullif(regexp_extract(locator, 'p\.?\s*(\d+)', 1), '') || '/', '')
    when key = 'blog' and two is not null and regexp_full_match(one, '\d{4}-\d{2}-\d{2}') then 'https://blog.example/' || replace(one, '-', '/') || '/' || two || '/' end as target,
    case when kind = 0 and two is not null then one end as stamp, case when kind = 0 and two is not null then two end as original from words
  where (kind = 0 and two is not null) or (kind = 1 and one is not null) or (key = 'blog' and two is not null and regexp_full_match(one, '\d{4}-\d{2}-\d{2}'))""",
    "path_to_citation": r"""select file_ord, row_ord, case row_ord % 5 when 0 then '[@cap 20010203040506 http://host.example/a/b/' || regexp_extract(url, '([^/]*)$', 1) || ']'
    when 1 then '[@cap 20010203040506 http://old.larkmoor.example/pages/section/' || source_key || '.html]' when 2 then '[@yearbook-1987 p.N]'
    when 3 then '[@blog 2019-10-05 ' || source_key || ']  → https://blog.example/2019/10/05/' || source_key || '/' else '(no rule for ' || url || ')' end as citation from bibliography where url is not null""",
}
