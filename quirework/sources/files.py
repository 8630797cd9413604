"""Sources that are files: YAML catalogs, tab-separated tables, pages, photos, settings."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions.text import decode_bytes

CATALOG = "source_key string, title string, entry_type string, file_format string, date_raw string, author string, url string, parts map<string,string>, held_by string, pages string, gaps string, notes string, evidence string"
_NAMES = {"key": "source_key", "type": "entry_type", "format": "file_format", "date": "date_raw"}


def yaml_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a folder's YAML files with file_ord (by file name) and row_ord, whatever their
    faults: operators.catalog tells those. Values become text as written by YAML's types; a file
    that isn't a list of mappings gives nothing. Needs PyYAML, which is imported on the executors."""
    columns = [c.split()[0] for c in CATALOG.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for frame in frames:
            rows = []
            for file, text in zip(frame["file"], frame["value"]):
                entries = yaml.safe_load(text)
                for at, entry in enumerate(entries if isinstance(entries, list) else []):
                    if isinstance(entry, dict):
                        named = {_NAMES.get(k, k): v for k, v in entry.items()}
                        parts = named.get("parts")
                        values = {c: None if named.get(c) is None else str(named[c]) for c in columns if c != "parts"}
                        values["parts"] = {str(k): str(v) for k, v in parts.items()} if isinstance(parts, dict) else None
                        rows.append({"file": file, "row_ord": at, **values})
            yield pd.DataFrame(rows, columns=["file", "row_ord", *columns])

    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.yaml").select(F.col("_metadata.file_name").alias("file"), "value")
    made = files.mapInPandas(read, f"file string, row_ord int, {CATALOG}")
    # one row for each file of the catalog
    ranks = files.select("file").distinct().withColumn("file_ord", F.row_number().over(Window.orderBy("file")))
    return made.join(ranks, "file").drop("file")


def tsv_editions(spark: SparkSession, path: str) -> DataFrame:
    """Glossary tables of a folder: edition (the file's name without .tsv; files that start with _
    are left out), file line row_ord, and the four fields. Quotes are ordinary characters; short
    rows have nulls, further fields are dropped; rows without a term are left out."""
    lines = spark.read.text(path, pathGlobFilter="[!_]*.tsv", wholetext=True)
    each = lines.select(F.regexp_replace("_metadata.file_name", r"\.tsv$", "").alias("edition"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("row_ord", "line"))
    parts = F.split("line", "\t", -1)
    fields = [F.get(parts, i).alias(n) for i, n in enumerate(("term", "definition", "source_key", "locator"))]
    return each.where("row_ord > 0 and trim(line) <> ''").select("edition", "row_ord", *fields).where("trim(term) <> ''")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """path, front (a map of the front matter's plain lines) and body of the Markdown pages below a
    folder. The front matter is what stands between a first line of --- and the next."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return front_matter(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), "text")


def quoted_manifest(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """The fields of a tab-separated manifest with a header, in which a value may be quoted to hold
    tabs, line ends and doubled quotes. A field that the header lacks raises."""
    read = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    if gone := [f for f in fields if f not in read.columns]:
        raise ValueError(f"fields {gone} are missing; there are {read.columns}")
    return read.select(*(F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields))


def front_matter(texts: DataFrame, text: str) -> DataFrame:
    """texts with front and body in place of text."""
    pattern = r"(?s)^---\n(.*?)\n---\n(.*)$"
    head = F.regexp_extract(text, pattern, 1)
    pairs = F.transform(F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_]+:")), lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z_]+):", 1).alias("k"), F.btrim(F.trim(F.regexp_extract(x, r"^[A-Za-z_]+:(.*)$", 1)), F.lit('"')).alias("v")))
    unique = F.filter(pairs, lambda x: x["k"] != "")
    has = F.col(text).rlike(r"(?s)^---\n.*?\n---\n")
    body = F.when(has, F.regexp_replace(F.regexp_extract(text, pattern, 2), r"^\n+", "")).otherwise(F.col(text))
    distinct = F.map_from_entries(F.array_distinct(unique))
    return texts.select(*(c for c in texts.columns if c != text), F.when(has, distinct).alias("front"), body.alias("body"))


def byte_pages(spark: SparkSession, path: str) -> DataFrame:
    """path and text of archived pages, decoded as a whole each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", decode_bytes(F.col("content")).alias("text"))


def images(spark: SparkSession, path: str, kinds: str = "{jpg,jpeg,png,webp}") -> DataFrame:
    """path, bytes and sha256 of the images below a folder; hidden files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"[!.]*.{kinds}").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def form_feed_pages(texts: DataFrame, doc: str, text: str, first_page: int = 1) -> DataFrame:
    """doc, page and text of extracts whose pages end with form feeds."""
    cut = F.posexplode(F.split(F.regexp_replace(text, r"\f$", ""), r"\f"))
    return texts.select(doc, cut.alias("_n", "text")).select(doc, (F.col("_n") + first_page).alias("page"), "text")


def strict(records: DataFrame, fields: list[str]) -> DataFrame:
    """Records with exactly these fields, as text, null as empty; other schemas raise."""
    if set(records.columns) != set(fields):
        raise ValueError(f"fields {sorted(records.columns)} instead of {sorted(fields)}")
    if held := [c for c, kind in records.dtypes if kind.startswith(("array", "map", "struct"))]:
        raise ValueError(f"fields that aren't single values: {held}")
    return records.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields))


def setting(argument: str | None, variable: str, config: dict[str, str], key: str, base: str | None = None) -> str | None:
    """An argument, else an environment variable, else a configured value, else nothing. An argument
    or variable counts from the working folder; a configured path counts from base, where given."""
    if told := argument or os.environ.get(variable):
        return os.path.expanduser(told)
    found = config.get(key)
    return os.path.join(base or "", os.path.expanduser(str(found))) if found else None
