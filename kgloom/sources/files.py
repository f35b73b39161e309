"""Readers: markdown pages with frontmatter, record tables, parsed documents, JSON-lines logs and graph snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import title

LINK = "array<struct<to:string,type:string>>"


def wiki_pages(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files under ``root`` as pages; files named ``index.md`` and ``log.md`` are left out.

    Frontmatter is ``key: value`` lines between ``---`` lines; JSON values of the list fields are parsed, other keys are kept in
    ``extra``.  A file without frontmatter is a page with a body only and ``has_frontmatter`` false.
    """
    raw = (
        spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(root, wholetext=True)
        .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
        .where(~F.col("path").rlike(r"/(?:index|log)\.md$"))
    )
    front = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*\r?\n(.*)$"
    has = F.col("text").rlike(front)
    pairs = F.filter(F.transform(F.split(F.regexp_extract("text", front, 1), "\r?\n"), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([A-Za-z_][\w-]*):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[A-Za-z_][\w-]*:(.*)$", 1)).alias("value"))), lambda p: p["key"] != "")
    keep_last = F.map_from_entries(F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])) == 0))
    own = raw.select("path", has.alias("has_frontmatter"), F.when(has, F.regexp_extract("text", front, 2)).otherwise(F.col("text")).alias("body"), F.when(has, keep_last).otherwise(F.create_map().cast("map<string,string>")).alias("m"))
    plain = lambda k: F.regexp_replace(F.col("m")[k], r"^[\"']|[\"']$", "")
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    known = ["id", "type", "sources", "links", "confidence", "updated", "title"]
    return own.select(
        F.coalesce(plain("id"), stem).alias("id"),
        plain("type").alias("type"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"),
        "path",
        F.coalesce(plain("title"), title("body", stem)).alias("title"),
        "body",
        F.coalesce(F.from_json(F.col("m")["sources"], "array<string>"), F.array().cast("array<string>")).alias("sources"),
        F.coalesce(F.from_json(F.col("m")["links"], LINK), F.array().cast(LINK)).alias("links"),
        F.expr("try_cast(m['confidence'] as double)").alias("confidence"),
        plain("updated").alias("updated"),
        "has_frontmatter",
        F.map_filter("m", lambda k, v: ~k.isin(known)).alias("extra"),
    )


def record_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text columns: header in the first line, byte-order mark removed, values trimmed, nulls as empty text."""
    rows = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").csv(path)
    return rows.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.lstrip("﻿").strip()) for c in rows.columns])


def text_document(spark: SparkSession, path: str) -> DataFrame:
    """Text, markdown and CSV files as parsed documents of one chunk, of type ``table`` for CSV; an empty file has no chunks."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("raw_path"), F.col("value").alias("markdown"))
    kind = F.when(F.col("raw_path").endswith(".csv"), "table").otherwise("text")
    chunk = F.array(F.struct(F.lit("liteparse-0").alias("id"), kind.alias("type"), F.col("markdown").alias("markdown")))
    return raw.select("raw_path", F.lit("liteparse").alias("provider"), "markdown", F.when(F.trim("markdown") == "", F.array().cast("array<struct<id:string,type:string,markdown:string>>")).otherwise(chunk).alias("chunks"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; blank and malformed lines are dropped."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), "value").where("r is not null and try_parse_json(value) is not null").select("r.*")


def snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A graph snapshot as frames by kind, each with the columns its rows have."""
    rows = spark.read.json(path)
    kinds = [r.kind for r in rows.select("kind").distinct().collect()]  # a handful of record kinds
    return {k: rows.where(F.col("kind") == k) for k in kinds}
