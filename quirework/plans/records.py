"""Queries over the catalog and the citations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as X
from quirework.operators import catalog as K
from quirework.operators import citations as C
from quirework.operators.ordered import one_of_each
from quirework.sources.tables import table

#: Types of entry that are listed first.
HEADINGS = ["handbook", "yearbook", "newspaper", "minutes"]
#: Addresses that are linked directly.
DIRECT = ["archive.larkmoor.example/larkmoor", "archive.larkmoor.example/wexholm"]


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    return K.load(table(spark, folder, "bibliography"))


def catalog_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return _catalog(spark, folder).select("source_key", "title", "file_ord", "row_ord")


def catalog_grouped(spark: SparkSession, folder: str) -> DataFrame:
    return K.grouped(_catalog(spark, folder), HEADINGS)


def catalog_detail(spark: SparkSession, folder: str) -> DataFrame:
    return K.details(_catalog(spark, folder))


def catalog_dates(spark: SparkSession, folder: str) -> DataFrame:
    """How precise each date is, the date itself where it is one, and how it is printed."""
    day = F.try_to_date("date_raw", "yyyy-MM-dd")
    entry = _catalog(spark, folder).withColumn("precision", K.date_precision(F.col("date_raw")))
    day = F.when(F.col("precision") == "day", day)
    return entry.select("source_key", "precision", day.alias("day"), F.date_format(day, "d MMM yyyy").alias("printed"))


def strict_records(spark: SparkSession, folder: str) -> DataFrame:
    return K.faults(table(spark, folder, "bibliography"))


def unknown_keys(spark: SparkSession, folder: str) -> DataFrame:
    return K.unknown_keys(table(spark, folder, "resolved_citations"), "cite_key", table(spark, folder, "bibliography"))


def citation_extract(spark: SparkSession, folder: str) -> DataFrame:
    return C.extract(table(spark, folder, "documents"), "doc_id", "text")


def citation_resolve(spark: SparkSession, folder: str) -> DataFrame:
    found = C.resolve(table(spark, folder, "resolved_citations"), _catalog(spark, folder))
    return found.select("citation_id", "url", "label", "hover_title", "found")


def footnote_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return C.references(table(spark, folder, "resolved_citations"), "page", "pos", "cite_key", "locator")


def footnote_uses(spark: SparkSession, folder: str) -> DataFrame:
    return C.uses(table(spark, folder, "resolved_citations"), "page", "pos", "cite_key", "locator", "citation_id").select("citation_id", "use_no")


def reference_backlinks(spark: SparkSession, folder: str) -> DataFrame:
    numbered = footnote_numbers(spark, folder)
    return numbered.select("page", "number", "key", "locator", C.backlinks(F.col("n_uses")).alias("back_links"))


def longest_word_match(spark: SparkSession, folder: str) -> DataFrame:
    """The part of the cited source that each locator names."""
    cited = table(spark, folder, "resolved_citations").select("cite_key", "locator").distinct()
    # at most one row a pair on the left, one a key on the right
    both = cited.join(_catalog(spark, folder).select(F.col("source_key").alias("cite_key"), "parts"), "cite_key")
    return both.select("cite_key", "locator", C.named_part(F.col("parts"), F.col("locator")).alias("part"))


def longest_prefix_match(spark: SparkSession, folder: str) -> DataFrame:
    """The longest known term each owlmanac entry's full text begins with."""
    entries = table(spark, folder, "owlmanac_2016")
    full = entries.select("entry_id", F.concat_ws(" ", "term", "definition").alias("full_text"))
    return C.longest_prefix(full, "entry_id", "full_text", table(spark, folder, "glossary").select("term"), "term")


def evidence_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags in the description of every entry, its class put as a tag and once as a link."""
    tagged = F.concat_ws(" ", "title", F.concat(F.lit("["), F.col("evidence"), F.lit("]")), F.concat(F.lit("["), F.col("evidence"), F.lit("](x.md)")), "gaps")
    found = table(spark, folder, "bibliography").select(F.explode(X.evidence_tags(tagged)).alias("evidence_class"))
    return found.groupBy("evidence_class").agg(F.count("*").alias("n_tags"))


def fence_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's text with a fenced block before its last line."""
    page = F.concat(F.col("text"), F.lit("\n```text\n[@hidden p.1]\n"), F.coalesce("source", F.lit("none")), F.lit("\n```\n"), F.col("doc_kind"))
    return table(spark, folder, "documents").select("doc_id", X.without_fences(page).alias("outside"))


def citation_format(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "glossary").select("entry_id", X.format_citation(F.col("source_key"), F.col("locator")).alias("citation"))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    """cited_in, url, src_ord and item: catalog addresses and parts, then those of the pages. An
    address with a wildcard is left out, a part with one is not."""
    entries = _catalog(spark, folder)
    urls = entries.where("url is not null and not contains(url, '*')").select(F.col("source_key").alias("cited_in"), "url", F.lit(1).alias("src_ord"), F.col("source_key").alias("item"))
    parts = entries.select("source_key", F.explode("parts").alias("name", "url")).select(F.col("source_key").alias("cited_in"), "url", F.lit(2).alias("src_ord"), F.concat("source_key", F.lit(" "), F.col("name")).alias("item"))
    pages = table(spark, folder, "resolved_citations").where("url is not null").select(F.col("page").alias("cited_in"), "url", F.lit(3).alias("src_ord"), F.lpad(F.col("citation_id").cast("string"), 18, "0").alias("item"))
    return urls.unionByName(parts).unionByName(pages)


def first_wins_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Every address once, with the first place that cites it."""
    return one_of_each(_targets(spark, folder), ["url"], ["src_ord", "item"], last=False).select("url", "cited_in", "src_ord")


def wildcard_exclude(spark: SparkSession, folder: str) -> DataFrame:
    return _targets(spark, folder).groupBy("src_ord").agg(F.count("*").alias("n_targets"), F.count_distinct("url").alias("n_urls"))


def archive_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    entries = _catalog(spark, folder).where("url is not null")
    return entries.select("source_key", X.archived_link(F.col("url"), DIRECT).alias("link"))


def url_target(spark: SparkSession, folder: str) -> DataFrame:
    """Time stamp and original of catalog addresses put behind an archive's."""
    entries = _catalog(spark, folder).where("url is not null")
    put = F.concat(F.lit("https://web.archive.org/web/"), F.date_format("added_at", "yyyyMMddHHmmss"), F.when(F.col("row_ord") % 2 == 0, "id_/").otherwise("/"), F.col("url"))
    stamp, original = X.capture_of(put)
    return entries.select("source_key", stamp.alias("stamp"), original.alias("original"))


#: What the ids of dated papers start with.
PAPERS = "w"


def issues(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "bibliography").select(F.concat_ws("\t", "source_key", "date_raw", "entry_type").alias("line"), "file_ord", "row_ord")
    return K.issue_dates(lines, "line", ["file_ord", "row_ord"], PAPERS)


def issue_date_dim(spark: SparkSession, folder: str) -> DataFrame:
    """Dates of papers from lines of two columns among other lines, the later line of a key winning."""
    return issues(spark, folder)


def nearest_capture(spark: SparkSession, folder: str) -> DataFrame:
    """For every purchase the user's view that is nearest in time."""
    events = table(spark, folder, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    viewed = events.where("event_type = 'view'").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return C.nearest_capture(bought, viewed, "key", "ts", "ts", "event_id")


QUERIES = {
    f.__name__: f
    for f in (
        catalog_last_wins, catalog_grouped, catalog_detail, catalog_dates, strict_records, unknown_keys, citation_extract, citation_resolve,
        footnote_numbers, footnote_uses, reference_backlinks, longest_word_match, longest_prefix_match, evidence_tags, fence_mask, citation_format,
        first_wins_targets, wildcard_exclude, archive_rewrite, url_target, issue_date_dim, nearest_capture,
    )
}

_CATALOG = """
with catalog as (select * from (select *, row_number() over (partition by source_key order by file_ord desc nulls last, row_ord desc nulls last) as k from bibliography where source_key <> '') where k = 1)
"""
_REFERENCES = r"""
with refs as (select page, cite_key as key, trim(regexp_replace(coalesce(locator, ''), '\s+', ' ', 'g')) as locator, pos, citation_id from resolved_citations where cite_key is not null),
grouped as (select page, key, locator, min(pos) as first_pos, count(*) as n_uses from refs group by all),
numbered as (select *, row_number() over (partition by page order by first_pos nulls first, key, locator) as number from grouped)
"""
_TARGETS = _CATALOG + """, targets as (
  select source_key as cited_in, url, 1 as src_ord, source_key as item from catalog where url is not null and not contains(url, '*')
  union all select source_key, e.value, 2, source_key || ' ' || e.key from (select source_key, unnest(map_entries(parts)) as e from catalog)
  union all select page, url, 3, lpad(cast(citation_id as varchar), 18, '0') from resolved_citations where url is not null)
"""

SQL = {
    "catalog_last_wins": _CATALOG + "select source_key, title, file_ord, row_ord from catalog",
    "catalog_grouped": _CATALOG + f""", typed as (select coalesce(entry_type, 'other') as entry_type, coalesce(list_position({HEADINGS}, entry_type), {len(HEADINGS) + 1}) as type_rank, source_key, coalesce(date_raw, '') || source_key as o from catalog)
  select entry_type, cast(type_rank as int) as type_rank, source_key, row_number() over (partition by entry_type order by o) as place_in_type, count(*) over (partition by entry_type) as n_of_type from typed""",
    "catalog_detail": _CATALOG + "select source_key, concat_ws('<br>', nullif(concat_ws(' · ', nullif(held_by, ''), nullif(pages, ''), nullif(gaps, '')), ''), nullif(notes, '')) as detail from catalog",
    "catalog_dates": _CATALOG + r""", d as (select source_key, case when date_raw is null then null when regexp_full_match(date_raw, '\d{4}-\d{2}-\d{2}') and try_cast(date_raw as date) is not null then 'day'
  when regexp_full_match(date_raw, '\d{4}-(0[1-9]|1[0-2])') then 'month' when regexp_full_match(date_raw, '\d{4}') then 'year' else 'text' end as precision, date_raw from catalog)
  select source_key, precision, case when precision = 'day' then cast(date_raw as date) end as day, case when precision = 'day' then strftime(cast(date_raw as date), '%-d %b %Y') end as printed from d""",
    "strict_records": """with r as (select *, max({'f': file_ord, 'r': row_ord}) over (partition by source_key) as last from bibliography),
  c as (select file_ord, row_ord, source_key as key, unnest([case when coalesce(source_key, '') = '' then 'no_key' end, case when source_key is not null and {'f': file_ord, 'r': row_ord} < last then 'key_taken_later' end,
    case when url is null and parts is null and held_by is null then 'no_place' end, case when evidence not in ('P', 'R', 'T') then 'unknown_evidence' end]) as code from r)
  select file_ord, row_ord, key, code, case when code in ('no_key', 'unknown_evidence') then 'error' else 'warning' end as severity from c where code is not null""",
    "unknown_keys": "select cite_key as key, count(*) as n_uses from resolved_citations where cite_key <> '' and cite_key not in (select source_key from bibliography where source_key is not null) group by cite_key",
    "citation_extract": r"""with p as (select doc_id, regexp_split_to_array(text, '(?ms)^```.*?^```[^\n]*$') as pieces from documents),
  e as (select doc_id, flatten(list_transform(pieces, lambda x: regexp_extract_all(x, '\[@([A-Za-z0-9][A-Za-z0-9._:-]*)((?:\s+[^\]]*)?)\]', 1))) as k, flatten(list_transform(pieces, lambda x: regexp_extract_all(x, '\[@([A-Za-z0-9][A-Za-z0-9._:-]*)((?:\s+[^\]]*)?)\]', 2))) as l from p)
  select doc_id, cast(i - 1 as int) as pos, k[i] as key, l[i] as locator from (select *, unnest(generate_series(1, len(k))) as i from e)""",
    "citation_resolve": _CATALOG + r""", named as (select source_key, e.key as name, e.value as link, o from (select source_key, unnest(map_entries(parts)) as e, generate_subscripts(map_entries(parts), 1) as o from catalog)),
  cited as (select citation_id, coalesce(cite_key, '') as key, trim(coalesce(locator, '')) as place from resolved_citations),
  matched as (select c.citation_id, arg_min(n.link, {'l': -length(n.name), 'o': n.o}) as link from cited c join named n on n.source_key = c.key and regexp_matches(' ' || lower(c.place) || ' ', '[^a-z0-9]' || regexp_escape(lower(n.name)) || '[^a-z0-9]') group by c.citation_id),
  based as (select c.*, b.source_key is not null as found, coalesce(m.link, b.url) as base, b.title, b.file_format, b.held_by, b.date_raw, regexp_extract(c.place, '\bp\.?\s*(\d+)', 1) as pg
    from cited c left join catalog b on b.source_key = c.key left join matched m on m.citation_id = c.citation_id)
  select citation_id, case when found then case when (coalesce(file_format = 'pdf', false) or ends_with(lower(base), '.pdf')) and pg <> '' then base || '#page=' || pg else base end end as url,
    case when found then coalesce(title, key) || case when place = '' then '' else ', ' || place end || case when base is null and coalesce(held_by, '') <> '' then ' (held by ' || held_by || ')' else '' end
      else '[@' || key || case when place = '' then '' else ' ' || place end || '] (unknown source key)' end as label,
    case when found then coalesce(title, key) || case when date_raw is null then '' else ' (' || date_raw || ')' end else 'unknown source key' end as hover_title, found from based""",
    "footnote_numbers": _REFERENCES + "select page, first_pos, key, locator, n_uses, number from numbered",
    "footnote_uses": _REFERENCES + "select citation_id, row_number() over (partition by page, key, locator order by pos nulls first, citation_id) as use_no from refs",
    "reference_backlinks": _REFERENCES + """select page, number, key, locator, case when n_uses = 1 then '^' else array_to_string(list_transform(generate_series(1, n_uses), lambda n: case when n <= 26 then chr(cast(n + 96 as int)) else cast(n as varchar) end), ' ') end as back_links from numbered""",
    "longest_word_match": _CATALOG + r""", named as (select source_key, unnest(map_keys(parts)) as name, generate_subscripts(map_keys(parts), 1) as o from catalog),
  pairs as (select distinct r.cite_key, r.locator from resolved_citations r join catalog on source_key = r.cite_key),
  best as (select p.cite_key, p.locator, arg_min(n.name, {'l': -length(n.name), 'o': n.o}) as part from pairs p join named n on n.source_key = p.cite_key and regexp_matches(' ' || lower(p.locator) || ' ', '[^a-z0-9]' || regexp_escape(lower(n.name)) || '[^a-z0-9]') group by all)
  select p.cite_key, p.locator, b.part from pairs p left join best b on b.cite_key = p.cite_key and b.locator = p.locator""",
    "longest_prefix_match": """with known as (select lower(term) as prefix, min(term) as term from glossary where contains(term, ' ') group by lower(term)),
  full_texts as (select entry_id, lower(concat_ws(' ', term, definition)) as t from owlmanac_2016)
  select entry_id, arg_max(term, length(prefix)) as term from full_texts join known on starts_with(t, prefix || ' ') group by entry_id""",
    "evidence_tags": "select evidence as evidence_class, count(*) as n_tags from bibliography where evidence in ('P', 'R', 'T') group by evidence",
    "fence_mask": r"select doc_id, regexp_replace(text || chr(10) || '```text' || chr(10) || '[@hidden p.1]' || chr(10) || coalesce(source, 'none') || chr(10) || '```' || chr(10) || doc_kind, '(?ms)^```.*?^```[^\n]*$', '', 'g') as outside from documents",
    "citation_format": "select entry_id, case when coalesce(source_key, '') = '' then '' else '[@' || source_key || case when trim(coalesce(locator, '')) = '' then '' else ' ' || trim(locator) end || ']' end as citation from glossary",
    "first_wins_targets": _TARGETS + "select url, arg_min(cited_in, {'s': src_ord, 'i': item, 'c': cited_in}) as cited_in, min(src_ord) as src_ord from targets group by url",
    "wildcard_exclude": _TARGETS + "select src_ord, count(*) as n_targets, count(distinct url) as n_urls from targets group by src_ord",
    "archive_rewrite": _CATALOG + """select source_key, case when starts_with(regexp_replace(url, '^[a-z]+://', ''), 'archive.larkmoor.example/larkmoor') or starts_with(regexp_replace(url, '^[a-z]+://', ''), 'archive.larkmoor.example/wexholm')
  or contains(url, '://archive.larkmoor.example/larkmoor') or contains(url, '://archive.larkmoor.example/wexholm') then url else 'https://web.archive.org/web/2/' || url end as link from catalog where url is not null""",
    "url_target": _CATALOG + "select source_key, strftime(added_at, '%Y%m%d%H%M%S') as stamp, url as original from catalog where url is not null",
    "issue_date_dim": r"""with l as (select concat_ws(chr(9), source_key, date_raw, entry_type) as line, file_ord, row_ord from bibliography),
  v as (select split_part(line, chr(9), 1) as paper, split_part(line, chr(9), 2) as issued, file_ord, row_ord from l where starts_with(line, 'w') and contains(line, chr(9)) and regexp_full_match(split_part(line, chr(9), 2), '\d{4}-\d{2}-\d{2}'))
  select paper, arg_max(issued, {'f': file_ord, 'r': row_ord}) as issued from v group by paper""",
    "nearest_capture": """select b.event_id as row_id, arg_min(v.ts, {'d': abs(epoch_us(v.ts) - epoch_us(b.ts)), 't': v.ts}) as captured_at from events b join events v on v.user_id = b.user_id and v.event_type = 'view' where b.event_type = 'purchase' group by b.event_id""",
}
