"""Queries of the general problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators.orphans import Reference, orphan_references, orphans_by_month
from quirework.operators.recover_rows import parse_lines, rejected_lines, valid_entries
from quirework.operators.snapshots import changes
from quirework.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejected_lines(parse_lines(table(spark, folder, "owlmanac_raw"))).select("line_id")


def p1_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The faulty lines with the reason and the cost of the cheapest repair."""
    bad = rejected_lines(parse_lines(table(spark, folder, "owlmanac_raw")))
    return bad.select("line_id", "cost", "reason", F.col("parsed.term").alias("term"), F.col("parsed.definition").alias("definition"))


def p1_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The valid lines as typed entries."""
    good = valid_entries(parse_lines(table(spark, folder, "owlmanac_raw")))
    return good.select("line_id", "term", "definition", "source_key", "locator", "page")


def _references(spark: SparkSession, folder: str) -> list[Reference]:
    citations, placements = table(spark, folder, "resolved_citations"), table(spark, folder, "placements")
    photos = table(spark, folder, "photo_manifest")
    # web_path is a fixed folder and the subpath; without that folder no subpath can match
    prefix = "docs/assets/photos/"
    photos = photos.where(F.col("web_path").startswith(prefix)).withColumn(
        "photo_subpath", F.substr("web_path", F.lit(len(prefix) + 1))
    )
    return [
        Reference(citations, "resolved_citations", "cite_key", "citation_id", "resolved_at", F.col("cite_key"), table(spark, folder, "bibliography"), "bibliography", "source_key", "added_at", "removed_at"),
        Reference(placements, "placements", "gallery_key", "placement_id", "placed_at", F.col("gallery_key"), table(spark, folder, "galleries"), "galleries", "gallery_key", "opened_at", "closed_at"),
        Reference(placements, "placements", "photo_subpath", "placement_id", "placed_at", F.col("photo_subpath"), photos, "photo_manifest", "photo_subpath", "added_at", "removed_at"),
    ]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(_references(spark, folder)).select("table_name", "field_name", "row_id")


def p6_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return orphans_by_month(orphan_references(_references(spark, folder)))


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    snapshots = table(spark, folder, "owlmanac_snapshots")
    return changes(snapshots, "snapshot_no", "term", "row_ord", ["definition", "source_key"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder).select("snapshot_no", F.col("key").alias("term"), "change_kind")


def p7_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The changes with the values before and after."""
    return _changes(spark, folder).withColumnRenamed("key", "term")


def p7_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many terms each delivery added, removed and changed."""
    return _changes(spark, folder).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n_terms"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_entries, p6_found, p6_by_month, p7_found, p7_changes, p7_summary)}

_LINES = r"""
with bare as (select line_id, case when starts_with(raw_line, chr(65279)) then substr(raw_line, 2) else raw_line end as a from owlmanac_raw),
lines as (select line_id, case when ends_with(a, chr(13)) then left(a, length(a) - 1) else a end as s from bare where a is not null),
split as (select line_id, s, regexp_full_match(s, '(?s)("(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)\t("(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)\t("(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)\t("(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)') as whole,
  regexp_extract(s, '(?s)^("(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)\t("(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)\t("(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)\t("(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)$', ['a','b','c','d']) as f
  from lines where s <> '' and not starts_with(s, '#')),
clean as (select line_id, s, whole,
  case when starts_with(f.a, '"') then replace(substr(f.a, 2, length(f.a) - 2), '""', '"') else f.a end as term,
  case when starts_with(f.b, '"') then replace(substr(f.b, 2, length(f.b) - 2), '""', '"') else f.b end as definition,
  case when starts_with(f.c, '"') then replace(substr(f.c, 2, length(f.c) - 2), '""', '"') else f.c end as source_key,
  case when starts_with(f.d, '"') then replace(substr(f.d, 2, length(f.d) - 2), '""', '"') else f.d end as locator from split),
judged as (select *, whole and regexp_matches(term, '[^\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') and length(term) <= 80
  and not regexp_matches(term || definition, '[\x{00}-\x{08}\x{0A}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]')
  and source_key = 'owlmanac-2016' and regexp_full_match(locator, '(p\.[1-9][0-9]*)?') as valid
  from clean where not (whole and term = 'term' and definition = 'definition' and source_key = 'source_key' and locator = 'locator'))
"""

_ORPHANS = """
with lost as (
  select 'resolved_citations' as table_name, 'cite_key' as field_name, c.citation_id as row_id, c.cite_key as key, c.resolved_at as made,
    exists (select 1 from bibliography b where b.source_key = c.cite_key and b.added_at <= c.resolved_at) as began,
    exists (select 1 from bibliography b where b.source_key = c.cite_key and b.added_at <= c.resolved_at and (b.removed_at is null or b.removed_at > c.resolved_at)) as there
  from resolved_citations c where c.cite_key <> ''
  union all
  select 'placements', 'gallery_key', p.placement_id, p.gallery_key, p.placed_at,
    exists (select 1 from galleries g where g.gallery_key = p.gallery_key and g.opened_at <= p.placed_at),
    exists (select 1 from galleries g where g.gallery_key = p.gallery_key and g.opened_at <= p.placed_at and (g.closed_at is null or g.closed_at > p.placed_at))
  from placements p where p.gallery_key <> ''
  union all
  select 'placements', 'photo_subpath', p.placement_id, p.photo_subpath, p.placed_at,
    exists (select 1 from photo_manifest m where m.web_path = 'docs/assets/photos/' || p.photo_subpath and m.added_at <= p.placed_at),
    exists (select 1 from photo_manifest m where m.web_path = 'docs/assets/photos/' || p.photo_subpath and m.added_at <= p.placed_at and (m.removed_at is null or m.removed_at > p.placed_at))
  from placements p where p.photo_subpath <> '')
"""

_CHANGES = """
with ranked as (select snapshot_no, term, definition, source_key, row_number() over (partition by snapshot_no, term order by row_ord desc nulls last, definition desc nulls last, source_key desc nulls last) as k
  from owlmanac_snapshots where term is not null),
latest as (select snapshot_no, term, definition, source_key from ranked where k = 1),
pairs as (select snapshot_no as before, lead(snapshot_no) over (order by snapshot_no) as after from (select distinct snapshot_no from latest)),
olds as (select after as snapshot_no, term, definition, source_key from latest join pairs on snapshot_no = before where after is not null),
news as (select snapshot_no, term, definition, source_key from latest join pairs on snapshot_no = after),
changed as (select coalesce(n.snapshot_no, o.snapshot_no) as snapshot_no, coalesce(n.term, o.term) as term,
  case when o.term is null then 'added' when n.term is null then 'removed' else 'changed' end as change_kind,
  o.definition as old_definition, n.definition as new_definition, o.source_key as old_source_key, n.source_key as new_source_key
  from news n full outer join olds o on n.snapshot_no = o.snapshot_no and n.term = o.term
  where n.term is null or o.term is null or n.definition is distinct from o.definition or n.source_key is distinct from o.source_key)
"""

SQL = {
    "p1_found": _LINES + "select line_id from judged where not valid",
    "p1_entries": _LINES + "select line_id, term, definition, source_key, locator, try_cast(regexp_extract(locator, '^p\\.([0-9]+)$', 1) as bigint) as page from judged where valid",
    "p6_found": _ORPHANS + "select table_name, field_name, row_id from lost where not there",
    "p6_by_month": _ORPHANS + "select table_name, field_name, strftime(made, '%Y-%m') as month, case when began then 'removed' else 'absent' end as state, count(*) as n_orphans, count(distinct key) as n_keys from lost where not there group by all",
    "p7_found": _CHANGES + "select snapshot_no, term, change_kind from changed",
    "p7_changes": _CHANGES + "select snapshot_no, term, change_kind, old_definition, new_definition, old_source_key, new_source_key from changed",
    "p7_summary": _CHANGES + "select snapshot_no, change_kind, count(*) as n_terms from changed group by all",
}
