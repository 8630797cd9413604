"""Queries of the training-data operators, with their SQL where there can be one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.encoding import garbled
from quirework.llm.leakage import leaks, without_leaks
from quirework.llm.ledger import copies, ledger_of
from quirework.llm.lookalikes import normalized_fields
from quirework.llm.near_duplicates import NearDuplicates
from quirework.llm.packing import containers, pack
from quirework.llm.scans import Repairs
from quirework.sources.tables import table


def _near(spark: SparkSession, folder: str) -> NearDuplicates:
    entries = table(spark, folder, "owlmanac_2016")
    text = F.concat(F.coalesce("term", F.lit("")), F.lit(" "), F.coalesce("definition", F.lit("")))
    return NearDuplicates(entries.select("entry_id", text.alias("text")), "entry_id", "text", 3, (1, 2))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).pairs().select(F.col("a").alias("entry_id_a"), F.col("b").alias("entry_id_b"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each entry with its class of near duplicates."""
    return _near(spark, folder).groups().withColumnRenamed("id", "entry_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "owlmanac_2016").select("entry_id", "term", "received_at")
    return copies(entries, ledger_of(entries, "term", "entry_id", "received_at"), "term", "entry_id")


def p4_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger: one row for each term however it is written, with its number of copies."""
    entries = table(spark, folder, "owlmanac_2016").select("entry_id", "term", "received_at")
    known = ledger_of(entries, "term", "entry_id", "received_at").read()
    return known.select(F.col("first.id").alias("first_entry_id"), F.col("first.term").alias("term"), F.col("n").alias("n_copies"))


def _consistent(spark: SparkSession, folder: str) -> DataFrame:
    return normalized_fields(table(spark, folder, "glossary"), "entry_id", ["term", "definition"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _consistent(spark, folder).where("size(kinds) > 0").select("entry_id", "field_name")


def p2_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every term and definition."""
    return _consistent(spark, folder)


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Each term in its consistent form, without regard to case, over all editions."""
    glossary = table(spark, folder, "glossary").select("entry_id", "edition", "term")
    terms = normalized_fields(glossary, "entry_id", ["term"]).select("entry_id", F.lower(F.trim("text")).alias("consistent_term"))
    # ids are unique, so neither side of this join has a hot key
    both = glossary.join(terms, "entry_id")
    return both.groupBy("consistent_term").agg(
        F.count("*").alias("n_entries"), F.count_distinct("edition").alias("n_editions"), F.count_distinct("term").alias("n_spellings")
    )


def _repairs(spark: SparkSession, folder: str) -> Repairs:
    rows = table(spark, folder, "glossary_rows")
    fields = [
        ("glossary", "definition", table(spark, folder, "glossary").select(F.col("entry_id").alias("row_id"), F.col("definition").alias("text"))),
        ("glossary_rows", "definition", rows.select("row_id", F.col("definition").alias("text"))),
        ("glossary_rows", "warnings", rows.select("row_id", F.explode("warnings").alias("text"))),
    ]
    return Repairs(table(spark, folder, "page_lines"), fields)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repairs(spark, folder).faults()


def p5_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The scanned pages as readable paragraphs."""
    return _repairs(spark, folder).paragraphs()


def p5_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The definitions and warnings as readable text."""
    return _repairs(spark, folder).repaired_fields().select("table_name", "field_name", "row_id", "repaired")


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text or part of one."""
    return pack(table(spark, folder, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """How full each container is."""
    return containers(pack(table(spark, folder, "documents"), "doc_id", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    documents, items = table(spark, folder, "documents"), table(spark, folder, "eval_items")
    return leaks(documents, items, "doc_id", "text", "item_id", "text").select("doc_id", "item_id")


def p9_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """The leaking documents without the leaked spans."""
    documents, items = table(spark, folder, "documents"), table(spark, folder, "eval_items")
    return without_leaks(documents, items, "doc_id", "text", "item_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled(table(spark, folder, "documents"), "doc_id", "text").select("doc_id")


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled documents with their text as far as it can be restored."""
    return garbled(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_normalized, p2_terms, p3_found, p3_groups, p4_found, p4_collapsed, p5_found, p5_paragraphs, p5_fields, p8_pack, p8_containers, p9_found, p9_cleaned, p10_found, p10_restored)}

_KEYS = r"""
with keyed as (select entry_id, term, array_to_string(list_sort(list_filter(list_transform(string_split(replace(replace(replace(lower(term), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's'), '/'),
  lambda x: regexp_replace(x, '[\s\v\p{Z}\p{P}\x{85}]+', '', 'g')), lambda x: x <> '')), '/') as key from owlmanac_2016 where term is not null),
ledger as (select key, min(entry_id) as first_entry_id, arg_min(term, entry_id) as term, count(*) as n from keyed group by key)
"""

_SHINGLES = r"""
with texts as (select entry_id, regexp_extract_all(lower(coalesce(term, '') || ' ' || coalesce(definition, '')), '[\p{L}\p{N}]+') as w from owlmanac_2016),
shingles as (select distinct entry_id, array_to_string(w[i:i+2], ' ') as s from (select entry_id, w, unnest(generate_series(1, len(w) - 2)) as i from texts)),
sizes as (select entry_id, count(*) as n from shingles group by entry_id),
common as (select a.entry_id as a, b.entry_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.entry_id < b.entry_id group by all)
"""

_WINDOWS = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
dw as (select doc_id, array_to_string(w[i:i+11], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 11)) as i from d)),
e as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
ew as (select item_id, array_to_string(w[i:i+11], ' ') as g from (select item_id, w, unnest(generate_series(1, len(w) - 11)) as i from e))
"""

SQL = {
    "p3_found": _SHINGLES + "select a as entry_id_a, b as entry_id_b from common join sizes x on x.entry_id = a join sizes y on y.entry_id = b where 3 * k >= x.n + y.n",
    "p3_groups": "with recursive" + _SHINGLES.strip()[4:] + """, sets as (select entry_id, string_agg(s, '|' order by s) as k from shingles group by entry_id),
classes as (select entry_id, min(entry_id) over (partition by k) as rep, count(*) over (partition by k) as n from sets),
links as (select a, b from common join sizes x on x.entry_id = a join sizes y on y.entry_id = b join classes p on p.entry_id = a join classes q on q.entry_id = b where 3 * k >= x.n + y.n and p.rep = a and q.rep = b),
ends as (select a as u, b as v from links union all select b, a from links),
reach(node, root) as (select rep, rep from classes where entry_id = rep union select e.v, r.root from reach r join ends e on e.u = r.node),
roots as (select node, min(root) as root from reach group by node), degrees as (select u, count(*) as d from ends group by u)
select entry_id, rep, root as group_id, n as n_copies, coalesce(d, 0) as n_links from classes join roots on node = rep left join degrees on u = rep
union all select entry_id, entry_id, entry_id, 1, 0 from owlmanac_2016 where entry_id not in (select entry_id from sets)""",
    "p9_found": _WINDOWS + "select distinct doc_id, item_id from dw join ew using (g)",
    "p9_cleaned": _WINDOWS.replace("select doc_id, array_to_string(w[i:i+11]", "select doc_id, i, array_to_string(w[i:i+11]") + r""", taken as (select distinct doc_id, unnest(generate_series(i, i + 11)) as k from (select distinct doc_id, i from dw join ew using (g))),
  t as (select doc_id, list(k) as ks, count(*) as n_removed from taken group by doc_id),
  p as (select doc_id, n_removed, ks, regexp_extract_all(text, '[\p{L}\p{N}]+') as w, regexp_split_to_array(text, '[\p{L}\p{N}]+') as g from documents join t using (doc_id))
  select doc_id, n_removed, array_to_string(list_transform(generate_series(1, len(w)), lambda i: case when not list_contains(ks, i) then g[i] || w[i] when list_contains(ks, i - 1) then '' else g[i] end), '') || g[len(w) + 1] as cleaned from p""",
    "p4_found": _KEYS + "select first_entry_id, entry_id as copy_entry_id from keyed join ledger using (key) where entry_id <> first_entry_id",
    "p4_collapsed": _KEYS + "select first_entry_id, term, n as n_copies from ledger",
}
