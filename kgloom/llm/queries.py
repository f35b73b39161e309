"""Queries of the training-text operators and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import boilerplate, leakage, neardup, scans, split, stuffing, tokens


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Items over the size limit."""
    return split.found(_table(spark, d, "parsed_documents").select("raw_path", "markdown", "chunks"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all items over the limit."""
    docs = _table(spark, d, "parsed_documents").select("raw_path", "markdown", "chunks")
    return split.pieces(split.items(docs), ["raw_path", "chunk_no"]).drop("item_chars", "longest_run").dropDuplicates(["raw_path", "chunk_no", "piece_no"])


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(_table(spark, d, "documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Furniture lines, cut words and misread words of scanned pages."""
    return scans.found(_table(spark, d, "parsed_documents").select("raw_path", "markdown", "chunks", "metadata"))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The text of each PDF document as continuous paragraphs."""
    return scans.repaired(_table(spark, d, "parsed_documents").select("raw_path", "markdown", "chunks", "metadata"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of web pages that are not part of the article."""
    return boilerplate.found(_table(spark, d, "parsed_documents").select("raw_path", "markdown", "metadata"))


def p5_articles(spark: SparkSession, d: str) -> DataFrame:
    """The article of each web page."""
    return boilerplate.main_text(_table(spark, d, "parsed_documents").select("raw_path", "markdown", "metadata"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pages whose bodies are nearly the same."""
    return neardup.pairs(_table(spark, d, "pages").select("id", "body"), "id", "body", size=3, threshold=0.7, least_words=20)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of pages with nearly the same body, on shingles of five words."""
    return neardup.groups(_table(spark, d, "pages").select("id", "body"), "id", "body")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with twelve words of an evaluation item in sequence."""
    return leakage.found(_table(spark, d, "documents").select("doc_id", "text"), _table(spark, d, "benchmark"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage of an evaluation item with at most one edit."""
    return leakage.leaks(_table(spark, d, "documents").select("doc_id", "text"), _table(spark, d, "benchmark"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Keyword-stuffed pages and lists of links."""
    return stuffing.found(_table(spark, d, "documents").select("doc_id", "text"))


def p9_pages(spark: SparkSession, d: str) -> DataFrame:
    """What the words of every document belong to."""
    return stuffing.pages(_table(spark, d, "documents").select("doc_id", "text"))


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired, "p3_found": p3_found, "p3_groups": p3_groups, "p5_found": p5_found, "p5_articles": p5_articles, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_pages": p9_pages, "p4_found": p4_found, "p4_pieces": p4_pieces, "p7_ids": p7_ids}

ORACLE = {
    "p3_found": r"""
WITH page AS (SELECT id, any_value(body) AS body FROM pages GROUP BY id),
word AS (SELECT id, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS w FROM page WHERE body IS NOT NULL),
gram AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM word WHERE len(w) >= 20),
pair AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.g, b.g)) AS c, len(a.g) + len(b.g) AS n FROM gram a JOIN gram b ON a.id < b.id AND len(a.g) >= 0.7 * len(b.g) AND len(b.g) >= 0.7 * len(a.g))
SELECT id_a, id_b FROM pair WHERE c >= 0.7 * (n - c)""",
    "p3_groups": r"""
WITH RECURSIVE page AS (SELECT id, any_value(body) AS body FROM pages GROUP BY id),
word AS (SELECT id, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS w FROM page WHERE body IS NOT NULL),
gram AS (SELECT id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM word WHERE len(w) > 0),
pair AS (SELECT a.id AS x, b.id AS y, len(list_intersect(a.g, b.g)) AS c, len(a.g) + len(b.g) AS n FROM gram a JOIN gram b ON a.id <> b.id AND len(a.g) >= 0.8 * len(b.g) AND len(b.g) >= 0.8 * len(a.g)),
edge AS (SELECT x, y FROM pair WHERE c >= 0.8 * (n - c)),
reach AS (SELECT id AS x, id AS y FROM gram UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y)
SELECT x AS id, min(y) AS group_id FROM reach GROUP BY x""",
    "p4_found": """
WITH docs AS (SELECT raw_path, any_value(markdown) AS markdown, any_value(chunks) AS chunks FROM parsed_documents GROUP BY raw_path),
item AS (SELECT raw_path, CAST(i AS BIGINT) AS chunk_no, chunks[i].markdown AS text FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM docs WHERE len(chunks) > 0)
  UNION ALL SELECT raw_path, CAST(0 AS BIGINT), markdown FROM docs WHERE chunks IS NULL OR len(chunks) = 0)
SELECT raw_path, chunk_no, 'oversized' AS kind FROM item WHERE length(text) > 2000
UNION ALL SELECT raw_path, chunk_no, 'unbreakable' FROM item WHERE length(text) > 2000 AND list_max(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: length(x))) > 2000""",
}
