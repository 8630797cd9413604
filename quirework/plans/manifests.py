"""Queries over manifests, links, pages and shapes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as X
from quirework.operators import manifests as M
from quirework.operators.catalog import kept_rows
from quirework.operators.shapes import commonest, in_place, judge, report
from quirework.sources.files import front_matter
from quirework.sources.tables import table

HEADER = ["term", "definition", "source_key", "locator"]
PREFIX = "docs/assets/photos/"


def _photos(spark: SparkSession, folder: str) -> DataFrame:
    photos = table(spark, folder, "photo_manifest")
    return photos.withColumn("photo_subpath", F.substr("web_path", F.lit(len(PREFIX) + 1)))


def manifest_sniff(spark: SparkSession, folder: str) -> DataFrame:
    return M.sniff(table(spark, folder, "owlmanac_raw"), "file_name", "row_ord", "raw_line", HEADER)


def manifest_union(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all files that can be read, in one table."""
    found = M.sniffed_union(table(spark, folder, "owlmanac_raw"), "file_name", "row_ord", "raw_line", HEADER)
    return found.select("file_name", "layout", "term", "source_key")


def kept_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Placements that are marked to be kept, by a mark in any writing, and those without a title."""
    marks = F.element_at(F.array(*map(F.lit, ("y", " Yes", "no", "", "YES ", "true", "Y"))), (F.col("placement_id") % 8 + 1).cast("int"))
    rows = table(spark, folder, "placements").where("placement_id % 8 < 7").select("placement_id", marks.alias("keep"), F.col("caption").alias("title"))
    return kept_rows(rows, "keep", "title").select("placement_id", "is_reported")


def _glyphs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    shape = F.floor(F.element_at("embedding", 1) * 40).cast("string")
    return rows.select((F.col("vec_id") % 10).alias("font"), shape.alias("shape"), F.col("label").cast("string").alias("extracted"), F.lit(1).cast("bigint").alias("n"), F.col("vec_id").alias("ord"))


def shape_report(spark: SparkSession, folder: str) -> DataFrame:
    return report(shape_vote(spark, folder)).select("place", "font", "broken")


def shape_commonest(spark: SparkSession, folder: str) -> DataFrame:
    return commonest(_glyphs(spark, folder)).select("font", "shape", "n", "place")


def shape_in_place(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as glyphs by number; the standard order has every other label."""
    rows = table(spark, folder, "embeddings")
    glyph = F.floor(F.col("vec_id") / 10)
    standard = table(spark, folder, "embeddings").where("vec_id % 10 = 0").select(glyph.alias("glyph"), F.col("label").cast("string").alias("meant"))
    return in_place(rows.select((F.col("vec_id") % 10).alias("font"), glyph.alias("glyph"), F.col("label").cast("string").alias("meant")), standard)


def manifest_missing(spark: SparkSession, folder: str) -> DataFrame:
    placed = table(spark, folder, "placements").select("placement_id", "photo_subpath")
    return M.missing(placed, _photos(spark, folder), "photo_subpath")


def manifest_plan(spark: SparkSession, folder: str) -> DataFrame:
    placed = table(spark, folder, "placements").where("photo_subpath <> ''")
    return M.plan(placed, _photos(spark, folder), "photo_subpath", F.split("photo_subpath", "/")[0])


def checksum_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return M.first_copies(items, "sha256", ["doc_id"])


def new_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of every fourth id and their texts are done already."""
    items = table(spark, folder, "documents").select("doc_id", F.sha1("text").alias("sha1"))
    return M.new_copies(items.where("doc_id % 4 <> 0"), items.where("doc_id % 4 = 0"), "sha1", ["doc_id"])


def gallery_photos(spark: SparkSession, folder: str) -> DataFrame:
    return M.grouped_items(table(spark, folder, "galleries"), table(spark, folder, "placements"), "gallery_key", "placement_id").select("gallery_key", "place", "placement_id")


def names(spark: SparkSession, folder: str) -> DataFrame:
    """Names and definitions of the glossary in the forms that names, list items and links need."""
    term, definition = F.coalesce("term", F.lit("")), F.coalesce("definition", F.lit(""))
    return table(spark, folder, "glossary").select("entry_id", X.squash_name(term).alias("squashed"), X.on_one_line(definition).alias("flat"), X.expand_ligature(F.substring(term, 1, 1)).alias("initial"))


def keyed_update(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with captions, topics and dates from the last placement of each photo."""
    photos = _photos(spark, folder).select("photo_subpath", "web_path", "added_at", "caption", "topic", "date_text")
    return M.keyed_update(photos, table(spark, folder, "placements"), "photo_subpath", ["caption", "topic", "date_text"], ["placed_at", "placement_id"])


def delimiter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return M.delimiter_faults(table(spark, folder, "owlmanac_2016"), ["entry_id"], ["term", "definition", "locator"])


def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "glossary").select("entry_id", X.slugify(F.coalesce("term", F.lit(""))).alias("slug"))


def slug_collisions(spark: SparkSession, folder: str) -> DataFrame:
    # every fifth topic already ends in a number, as names that were numbered by hand do
    topic = F.when(F.col("placement_id") % 5 == 0, F.concat(F.coalesce("topic", F.lit("")), F.lit(" "), (F.col("placement_id") % 4).cast("string"))).otherwise(F.col("topic"))
    items = table(spark, folder, "placements").select("placement_id", F.coalesce("gallery_key", F.lit("")).alias("gallery_key"), topic.alias("topic"))
    return M.slugged(items, "gallery_key", "topic", "placement_id").select("placement_id", "name")


def groups_with_empty(spark: SparkSession, folder: str) -> DataFrame:
    return M.with_empty_groups(table(spark, folder, "galleries"), table(spark, folder, "placements"), "gallery_key")


def photo_credit(spark: SparkSession, folder: str) -> DataFrame:
    """A placement's credit as the manifest has it: the plain credit and the keys it cites."""
    keys = F.transform(F.regexp_extract_all("credit_citation", F.lit(r"\[@([A-Za-z0-9][A-Za-z0-9._:-]*)"), F.lit(1)), lambda k: F.concat(F.lit("@"), k))
    cited = F.nullif(F.array_join(keys, "; "), F.lit(""))
    credit = F.concat_ws(" — ", F.nullif("credit_plain", F.lit("")), cited)
    return table(spark, folder, "placements").select("placement_id", credit.alias("credit"))


def page_url(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "galleries").select("gallery_key", X.page_url(F.concat(F.lit("docs/"), F.col("page_path")), "https://site.example/").alias("url"))


def page_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a page shows its actions: not the home page, not about/, not where its front matter
    says so (here that of pages whose name has an x)."""
    path = F.col("page")
    pages = table(spark, folder, "resolved_citations").select("page").distinct()
    told = F.when(F.contains(path, F.lit("x")), F.lit("page_actions: false")).otherwise("title: a")
    pages = front_matter(pages.withColumn("text", F.concat(F.lit("---\n"), told, F.lit("\n---\nbody"))), "text")
    shown = X.shows_actions(path, F.col("front"))
    title = F.url_encode(F.regexp_replace(path, r"\.md$", ""))
    return pages.select("page", shown.alias("shown"), F.when(shown, title).alias("title"))


def signed_limit(spark: SparkSession, folder: str) -> DataFrame:
    return M.signed_limit(table(spark, folder, "bibliography").select("file_ord", "row_ord"), ["file_ord", "row_ord"], -25)


def html_escape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "owlmanac_2016").select("entry_id", X.html_escape(F.concat(F.lit("<b>"), F.concat_ws(" ", "term", "definition"), F.lit("</b> & '"))).alias("escaped"))


def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    """Each entry put into a page and back to text."""
    page = F.concat(
        F.lit("<html><head><script>var a = '<p>';</script></head><body><!-- no --><h1 class=\"x\">"), F.coalesce("term", F.lit("")),
        F.lit("</h1><p>"), F.replace(F.coalesce("locator", F.lit("none")), F.lit("."), F.lit(".&nbsp;")), F.lit(" "), X.html_escape(F.regexp_replace(F.coalesce("definition", F.lit("")), r"(?U)\s+", "_")), F.lit("<br/>next &lt;line&gt; &amp; more</p ><ul><li>one</li><li>two</li></ul></body></html>"),
    )
    return table(spark, folder, "glossary_rows").select("row_id", X.html_to_text(page).alias("text"))


def link_extract(spark: SparkSession, folder: str) -> DataFrame:
    cited = table(spark, folder, "resolved_citations")
    page = F.concat(F.lit('<a href="'), F.coalesce("url", F.lit("none.html")), F.lit('">'), F.coalesce("label", F.lit("")), F.lit("</a> <a href='y'>"))
    return cited.select("citation_id", F.explode(X.links(page)).alias("link"))


def bytes_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Documents stored as UTF-8 or, every third, as Latin-1 bytes."""
    data = F.when(F.col("doc_id") % 3 == 0, F.encode(F.concat(F.regexp_replace("text", r"[^\x{00}-\x{7E}\x{A0}-\x{FF}]", "-"), F.lit(" é")), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    made = table(spark, folder, "documents").select("doc_id", X.decode_bytes(data).alias("t"))
    return made.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def version_table(spark: SparkSession, folder: str) -> DataFrame:
    snapshots = table(spark, folder, "owlmanac_snapshots")
    tag = F.when(F.col("snapshot_no") == 1, "seed-1").otherwise(F.concat(F.lit("delivery-"), F.col("snapshot_no").cast("string")))
    grouped = snapshots.groupBy("snapshot_no", tag.alias("tag")).agg(F.min("snapshot_date").alias("day"), F.count("*").alias("n"))
    files = F.array(F.lit("b.md"), F.lit("README.md"), F.lit("a.md"), F.lit("b.md"), F.lit("x.tsv"))
    return M.versions(grouped.select("tag", "day", F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("subject"), files.alias("files")))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Events as answers of probes."""
    events = table(spark, folder, "events")
    return events.select(
        "event_id", F.concat(F.lit("https://site.example/"), F.col("user_id").cast("string")).alias("target"), F.col("event_type").alias("cited_in"),
        F.when(F.col("event_id") % 4 == 0, "capture").otherwise("page").alias("kind"),
        F.when(F.col("event_id") % 7 == 0, "timeout").alias("error"), (F.lit(200) + (F.col("event_id") % 3) * 102).cast("int").alias("status"),
        F.when(F.col("event_id") % 8 == 0, "20200101").alias("closest"),
    )


def link_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return M.verdicts(_results(spark, folder)).select("event_id", "passed", "outcome")


def link_report(spark: SparkSession, folder: str) -> DataFrame:
    return M.report(M.verdicts(_results(spark, folder)), "target", "cited_in")


def fetch_state(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events as attempts: a purchase is a fetched file, a click a throttled answer."""
    events = table(spark, folder, "events")
    outcome = F.when(F.col("event_type") == "purchase", "fetched").when(F.col("event_type") == "click", "throttled").otherwise("failed")
    state = M.fetch_state(events.select("event_id", "user_id", outcome.alias("outcome")), "user_id", "event_id", "outcome")
    wait = F.when(F.col("failures") > 0, X.backoff(F.lit(None).cast("double"), F.col("failures")))
    return state.select("event_id", "failures", "stopped", wait.alias("wait"))


def backoff(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    asked = F.when(F.col("event_id") % 10 == 0, F.lit(0.0)).when(F.col("event_id") % 2 == 0, F.col("value") * 10)
    return events.select("event_id", X.backoff(asked, F.col("event_id") % 6 + 1).alias("wait"))


def shape_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as letters: a font is a row of ten, the shape its first number, cut, the label
    what is read, and the label of the first rows what is meant."""
    rows = table(spark, folder, "embeddings")
    shape = F.floor(F.element_at("embedding", 1) * 40).cast("string")
    glyphs = rows.select((F.col("vec_id") % 10).alias("font"), shape.alias("shape"), F.col("label").cast("string").alias("extracted"), F.lit(1).cast("bigint").alias("n"), F.col("vec_id").alias("ord"))
    reference = glyphs.where("ord % 4 = 0").select("shape", F.col("extracted").alias("meant"), "ord")
    return judge(glyphs, reference)


QUERIES = {
    f.__name__: f
    for f in (
        manifest_sniff, manifest_union, kept_questions, shape_report, shape_commonest, shape_in_place, manifest_missing, manifest_plan, checksum_dedupe, new_copies, gallery_photos, names, keyed_update, delimiter_audit, slugs, slug_collisions, groups_with_empty,
        photo_credit, page_url, page_actions, signed_limit, html_escape, html_to_text, link_extract, bytes_decode, version_table, link_verdict,
        link_report, fetch_state, backoff, shape_vote,
    )
}

_PHOTOS = "with photos as (select *, substr(web_path, 20) as photo_subpath from photo_manifest)"
_RESULTS = """
with results as (select event_id, 'https://site.example/' || cast(user_id as varchar) as target, event_type as cited_in, case when event_id % 4 = 0 then 'capture' else 'page' end as kind,
  case when event_id % 7 = 0 then 'timeout' end as error, 200 + (event_id % 3) * 102 as status, case when event_id % 8 = 0 then '20200101' end as closest from events),
judged as (select *, case when error is not null then false when kind = 'capture' then closest is not null else status < 400 end as passed,
  case when error is not null then error when kind = 'capture' then case when closest is not null then 'captured' else 'no capture' end else cast(status as varchar) end as outcome from results)
"""

SQL = {
    "manifest_sniff": "select file_name, count(*) as n_lines, case when arg_min(list_slice(string_split(coalesce(raw_line, ''), chr(9)), 1, 4), row_ord) = ['term', 'definition', 'source_key', 'locator'] then 'records' when bool_and(len(string_split(coalesce(raw_line, ''), chr(9))) = 2) then 'pairs' else 'skipped' end as layout from owlmanac_raw group by file_name",
    "manifest_union": """with told as (select file_name, min(row_ord) as f, case when arg_min(list_slice(string_split(coalesce(raw_line, ''), chr(9)), 1, 4), row_ord) = ['term', 'definition', 'source_key', 'locator'] then 'records' when bool_and(len(string_split(coalesce(raw_line, ''), chr(9))) = 2) then 'pairs' else 'skipped' end as layout from owlmanac_raw group by file_name)
  select r.file_name, layout, string_split(coalesce(raw_line, ''), chr(9))[1] as term, string_split(coalesce(raw_line, ''), chr(9))[3] as source_key from owlmanac_raw r join told using (file_name) where layout = 'pairs' or (layout = 'records' and row_ord > f)""",
    "kept_questions": "select placement_id, trim(coalesce(caption, '')) = '' as is_reported from placements where placement_id % 8 in (0, 1, 4, 6)",
    "shape_report": "select row_number() over (order by not broken, font) as place, font, broken from (" + "@VOTE" + ")",
    "shape_commonest": "select * from (select font, shape, n, row_number() over (partition by font order by n desc, shape) as place from (select vec_id % 10 as font, cast(cast(floor(embedding[1] * cast(40 as float)) as bigint) as varchar) as shape, count(*) as n from embeddings group by all)) where place <= 120",
    "shape_in_place": """select e.vec_id % 10 as font, count(*) as n_checked, count(*) filter (e.label = s.label) as n_in_place, count(*) >= 3 and count(*) filter (e.label = s.label) * 10 >= count(*) * 9 as follows
  from embeddings e join embeddings s on s.vec_id % 10 = 0 and s.vec_id // 10 = e.vec_id // 10 group by e.vec_id % 10""",
    "manifest_missing": _PHOTOS + " select placement_id, photo_subpath from placements p where not exists (select 1 from photos f where f.photo_subpath = p.photo_subpath)",
    "manifest_plan": _PHOTOS + """, m as (select split_part(photo_subpath, '/', 1) as folder, photo_subpath in (select photo_subpath from photos where photo_subpath is not null) as there from placements where photo_subpath <> '')
  select folder, count(*) as n_listed, count(*) filter (not there) as n_missing, count(*) filter (not there) * 5 as seconds from m group by folder""",
    "checksum_dedupe": "select sha256(text) as sha256, min(doc_id) as doc_id, count(*) as n_copies from documents where text is not null group by 1",
    "new_copies": "select min(doc_id) as doc_id, sha1(text) as sha1 from documents where text is not null and doc_id % 4 <> 0 and sha1(text) not in (select sha1(text) from documents where text is not null and doc_id % 4 = 0) group by sha1(text)",
    "gallery_photos": "select g.gallery_key, case when p.placement_id is not null then row_number() over (partition by g.gallery_key order by p.placement_id) end as place, p.placement_id from (select distinct gallery_key from galleries where gallery_key is not null) g left join placements p using (gallery_key)",
    "names": """select entry_id, regexp_replace(lower(coalesce(term, '')), '[^a-z0-9]', '', 'g') as squashed, replace(regexp_replace(coalesce(definition, ''), '^[\\s\\v\\x{85}\\p{Z}]+|[\\s\\v\\x{85}\\p{Z}]+$', '', 'g'), chr(10), ' ') as flat,
  case left(coalesce(term, ''), 1) when 'ﬀ' then 'ff' when 'ﬁ' then 'fi' when 'ﬂ' then 'fl' when 'ﬃ' then 'ffi' when 'ﬄ' then 'ffl' when 'ﬅ' then 'st' when 'ﬆ' then 'st' else left(coalesce(term, ''), 1) end as initial from glossary""",
    "keyed_update": _PHOTOS + """, last as (select photo_subpath, caption, topic, date_text from (select *, row_number() over (partition by photo_subpath order by placed_at desc nulls last, placement_id desc) as k from placements where photo_subpath is not null) where k = 1)
  select f.photo_subpath, f.web_path, f.added_at, coalesce(nullif(l.caption, ''), f.caption) as caption, coalesce(nullif(l.topic, ''), f.topic) as topic, coalesce(nullif(l.date_text, ''), f.date_text) as date_text from photos f left join last l on l.photo_subpath = f.photo_subpath""",
    "delimiter_audit": r"select entry_id, column_name from (select entry_id, unnest(['term', 'definition', 'locator']) as column_name, unnest([term, definition, locator]) as v from owlmanac_2016) where regexp_matches(v, '[\t\r\n]')",
    "slugs": "select entry_id, coalesce(nullif(trim(regexp_replace(lower(coalesce(term, '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'img') as slug from glossary",
    "slug_collisions": """with s as (select placement_id, coalesce(gallery_key, '') as g, coalesce(nullif(trim(regexp_replace(lower(case when placement_id % 5 = 0 then coalesce(topic, '') || ' ' || (placement_id % 4) else coalesce(topic, '') end), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'img') as slug from placements),
  lists as (select g, list(placement_id order by placement_id) as ids, list(slug order by placement_id) as slugs from s group by g),
  named as (select g, ids, list_reduce(slugs, lambda done, x: list_append(done, case when not list_contains(done, x) then x else list_filter(list_transform(generate_series(2, len(done) + 2), lambda n: x || '-' || n), lambda y: not list_contains(done, y))[1] end), cast([] as varchar[])) as names from lists)
  select unnest(ids) as placement_id, unnest(names) as name from named""",
    "groups_with_empty": "select g.gallery_key, count(p.placement_id) as n_items from (select distinct gallery_key from galleries) g left join placements p on p.gallery_key = g.gallery_key group by g.gallery_key",
    "photo_credit": "select placement_id, concat_ws(' — ', nullif(credit_plain, ''), nullif(array_to_string(list_transform(regexp_extract_all(credit_citation, '\\[@([A-Za-z0-9][A-Za-z0-9._:-]*)', 1), lambda k: '@' || k), '; '), '')) as credit from placements",
    "page_url": "select gallery_key, 'https://site.example/' || regexp_replace(regexp_replace(page_path, '\\.md$', '/'), '(^|/)index/$', '\\1') as url from galleries",
    "page_actions": "select page, page <> 'index.md' and not starts_with(page, 'about/') and not contains(page, 'x') as shown, case when page <> 'index.md' and not starts_with(page, 'about/') and not contains(page, 'x') then url_encode(regexp_replace(page, '\\.md$', '')) end as title from (select distinct page from resolved_citations)",
    "signed_limit": "select file_ord, row_ord from (select file_ord, row_ord, row_number() over (order by file_ord desc, row_ord desc) as k from bibliography) where k > 25",
    "html_escape": "select entry_id, '&lt;b&gt;' || replace(replace(replace(replace(replace(concat_ws(' ', term, definition), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || '&lt;/b&gt; &amp; &#x27;' as escaped from owlmanac_2016",
    "link_extract": "select citation_id, url as link from resolved_citations where regexp_matches(url, '^https?://')",
    "bytes_decode": """with t as (select doc_id, case when doc_id % 3 = 0 then regexp_replace(text, '[^\\x{00}-\\x{7E}\\x{A0}-\\x{FF}]', '-', 'g') || ' é' else text end as t from documents) select doc_id, length(t) as n_chars, md5(t) as digest from t""",
    "version_table": """with g as (select snapshot_no, min(snapshot_date) as day, count(*) as n from owlmanac_snapshots group by 1),
  r as (select day, '| ' || cast(day as varchar) || ' | delivery-' || snapshot_no || ' | ' || n || ' rows | a.md, b.md |' as row_text from g where snapshot_no <> 1)
  select row_number() over (order by day, row_text) as place, row_text from r""",
    "link_verdict": _RESULTS + "select event_id, passed, outcome from judged",
    "link_report": _RESULTS + "select passed, outcome, target, count(*) as n_cited, min(cited_in) as first_cited_in from judged group by all",
    "fetch_state": """with a as (select event_id, user_id, case event_type when 'purchase' then 'fetched' when 'click' then 'throttled' else 'failed' end as outcome from events),
  b as (select *, count(*) filter (outcome = 'fetched') over (partition by user_id order by event_id) as block from a),
  c as (select event_id, user_id, count(*) filter (outcome = 'throttled') over (partition by user_id, block order by event_id) as failures from b)
  select event_id, failures, max(failures) over (partition by user_id order by event_id) >= 5 as stopped, case when failures > 0 then least(60 * pow(2.0, failures - 1), 900.0) end as wait from c""",
    "backoff": "select event_id, least(coalesce(nullif(case when event_id % 10 = 0 then 0.0 when event_id % 2 = 0 then value * 10 end, 0), 60 * pow(2.0, event_id % 6)), 900.0) as wait from events",
    "shape_vote": """with g as (select vec_id % 10 as font, cast(cast(floor(embedding[1] * cast(40 as float)) as bigint) as varchar) as shape, cast(label as varchar) as extracted, vec_id as ord from embeddings),
  ref as (select shape, arg_min(extracted, ord) as meant from g where ord % 4 = 0 group by shape),
  sums as (select font, shape, extracted, count(*) as n, min(ord) as f from g group by all),
  read as (select font, shape, arg_max(extracted, {'n': n, 'f': -f}) as extracted from sums group by font, shape),
  j as (select font, count(*) as n_matched, count(*) filter (extracted is not distinct from meant) as n_agreeing from read join ref using (shape) group by font)
  select font, n_matched, n_agreeing, n_matched >= 3 and n_agreeing * 2 < n_matched as broken from j""",
    "html_to_text": """select row_id, regexp_replace('# ' || coalesce(term, '') || chr(10) || ' ' || replace(coalesce(locator, 'none'), '.', '. ') || ' ' || regexp_replace(coalesce(definition, ''), '[\\s\\v\\x{85}\\p{Z}]+', '_', 'g') || chr(10), '[ \\t\\r\\x{A0}]+', ' ', 'g') || 'next <line> & more - one' || chr(10) || '- two' as text from glossary_rows""",
}
SQL["shape_report"] = SQL["shape_report"].replace("@VOTE", SQL["shape_vote"])
