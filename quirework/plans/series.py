"""Queries over the editions of the glossary, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import normalise_definition, normalise_term
from quirework.operators import series as S
from quirework.sources.tables import table

#: Invented aliases that stand for a configured table of them.
ALIASES = {"deja tugsok scoreboard cup": "tugsok scoreboard cup", "vekmod gong prize": "gong prize", "nolmur lecture bridge": "nolmur lecture"}


def _lined(spark: SparkSession, folder: str) -> DataFrame:
    return S.series(table(spark, folder, "glossary"), ALIASES)


def edition_order(spark: SparkSession, folder: str) -> DataFrame:
    return S.editions(table(spark, folder, "glossary"))


def edition_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return _lined(spark, folder).select("edition", "key", "entry_id", "term")


def term_recurrence(spark: SparkSession, folder: str) -> DataFrame:
    return S.recurrence(_lined(spark, folder)).select("key", "n_editions", "kind")


def first_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return S.recurrence(_lined(spark, folder)).select("key", "first_spelling")


def series_years(spark: SparkSession, folder: str) -> DataFrame:
    return S.recurrence(_lined(spark, folder)).select("key", "years")


def display_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each term in its list, by its name as shown."""
    return S.display_order(_lined(spark, folder))


def one_offs_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return S.one_offs_by_year(_lined(spark, folder))


def edition_diff(spark: SparkSession, folder: str) -> DataFrame:
    return S.neighbour_changes(_lined(spark, folder))


def edition_diff_counts(spark: SparkSession, folder: str) -> DataFrame:
    return S.neighbour_changes(_lined(spark, folder)).groupBy("position", "change").agg(F.count("*").alias("n_terms"))


def edition_pair_report(spark: SparkSession, folder: str) -> DataFrame:
    return S.pair_report(_lined(spark, folder), "almanac-2016", "owlmanac-2016")


def term_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "glossary").select("entry_id", normalise_term(F.col("term"), ALIASES).alias("key"))


def definition_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "glossary").select("entry_id", normalise_definition(F.col("definition")).alias("words"))


QUERIES = {f.__name__: f for f in (edition_order, edition_last_wins, term_recurrence, first_spelling, series_years, display_order, one_offs_by_year, edition_diff, edition_diff_counts, edition_pair_report, term_normalise, definition_normalise)}

_MAP = "map([" + ", ".join(f"'{k}'" for k in ALIASES) + "], [" + ", ".join(f"'{v}'" for v in ALIASES.values()) + "])"
_TARGETS = ", ".join(f"'{v}'" for v in sorted(set(ALIASES.values())))
_KEY = f"""
with plain as (select *, regexp_replace(trim(regexp_replace(lower(term), '[^a-z0-9 ]', '', 'g')), ' +', ' ', 'g') as p from glossary),
named as (select *, coalesce({_MAP}[p], p) as q from plain),
keyed as (select *, case when starts_with(q, 'the ') and substr(q, 5) in ({_TARGETS}) then substr(q, 5) else q end as key from named)
"""
_LINED = _KEY + r""", e as (select edition, case when y <> '' then cast(y as int) else 9999 end as year, case when y <> '' then regexp_replace(edition, '-[0-9]{4}$', '') else edition end as suffix,
  case when y <> '' then y || '-' || regexp_replace(edition, '-[0-9]{4}$', '') else edition end as label
  from (select distinct edition, regexp_extract(edition, '-([0-9]{4})$', 1) as y from glossary where edition is not null)),
eds as (select *, cast(row_number() over (order by year, suffix) as int) as position from e),
ranked as (select *, row_number() over (partition by edition, key order by file_ord desc nulls last, row_ord desc nulls last, entry_id desc) as k from keyed where key <> '' and edition is not null),
lined as (select r.edition, r.key, r.entry_id, r.term, r.definition, r.file_ord, r.row_ord, eds.position, eds.year, trim(regexp_replace(lower(r.definition), '[^\p{L}\p{N}_]+', ' ', 'g')) as words from ranked r join eds on r.edition = eds.edition where k = 1),
grouped as (select key, arg_min(term, position) as first_spelling, count(*) as n_editions, case when count(*) > 1 then 'recurring' else 'one-off' end as kind,
  array_to_string(list_transform(list_sort(list({'p': position, 'y': year})), lambda x: cast(x.y as varchar)), ', ') as years from lined group by key),
olds as (select position + 1 as position, key, words from lined where position < (select max(position) from lined)),
news as (select position, key, words from lined where position > 1),
changed as (select coalesce(n.position, o.position) as position, coalesce(n.key, o.key) as key, case when o.key is null then 'added' when n.key is null then 'dropped' else 'reworded' end as change
  from news n full outer join olds o on n.position = o.position and n.key = o.key where n.key is null or o.key is null or n.words is distinct from o.words)
"""

SQL = {
    "edition_order": _LINED + "select edition, year, suffix, label, position from eds",
    "edition_last_wins": _LINED + "select edition, key, entry_id, term from lined",
    "term_recurrence": _LINED + "select key, n_editions, kind from grouped",
    "first_spelling": _LINED + "select key, first_spelling from grouped",
    "series_years": _LINED + "select key, years from grouped",
    "display_order": _LINED + """, firsts as (select key, case when count(*) > 1 then 'recurring' else 'one-off' end as kind, min({'p': position, 'f': file_ord, 'r': row_ord, 't': term}) as first from lined group by key)
  select key, kind, row_number() over (partition by kind order by lower(first.t), first.p, first.f nulls first, first.r nulls first, key) as place from firsts""",
    "one_offs_by_year": _LINED + "select year, count(*) as n_terms, string_agg(term, '; ' order by term) as terms from (select key, min(year) as year, min(term) as term from lined group by key having count(*) = 1) group by year",
    "edition_diff": _LINED + "select position, key, change from changed",
    "edition_diff_counts": _LINED + "select position, change, count(*) as n_terms from changed group by all",
    "edition_pair_report": _LINED + """select coalesce(n.key, o.key) as key, case when o.key is null then 'added' when n.key is null then 'dropped' when n.words is distinct from o.words then 'reworded' else 'same' end as change,
  o.definition as old_definition, n.definition as new_definition from (select * from lined where edition = 'owlmanac-2016') n full outer join (select * from lined where edition = 'almanac-2016') o on n.key = o.key""",
    "term_normalise": _KEY + "select entry_id, key from keyed",
    "definition_normalise": r"select entry_id, trim(regexp_replace(lower(definition), '[^\p{L}\p{N}_]+', ' ', 'g')) as words from glossary",
}
