"""The queries of the core's data-processing problems and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import hierarchy as H
from .operators import orphans as O

CRAWL = ("url", "parent_url", "depth", "fetched_at")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose crawl depth is wrong, and pages whose chain of parents never ends."""
    return H.wrong_depths(_table(spark, d, "crawl_pages").select(*CRAWL))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every page of a tree: root, depth, number of descendants, their interval of pre-order numbers and the full path."""
    nodes, members, _ = H.hierarchy(_table(spark, d, "crawl_pages").select(*CRAWL))
    roots = nodes.select(F.col("id").alias("root"), F.col("url").alias("root_url"))
    return (
        members.join(nodes.select("id", "url"), "id")
        .join(roots, "root")
        .join(H.paths(nodes, members), "id")
        .select("url", "root_url", "real_depth", (F.col("size") - 1).alias("descendants"), "pre", (F.col("pre") + F.col("size")).alias("pre_end"), F.array_join("path", " > ").alias("path"))
    )


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth, number of descendants and full path of every page of a tree."""
    return p2_hierarchy(spark, d).drop("pre", "pre_end")


def _orphans(spark: SparkSession, d: str) -> O.OrphanState:
    links, ps = _table(spark, d, "links"), _table(spark, d, "page_sources")
    refs = [O.references(links, "links", "link_no", {"from_id": "pages", "to_id": "pages"}), O.references(ps, "page_sources", "row_no", {"source_id": "sources"})]
    own = ("id", "recorded_at", "deleted_at")
    return O.track(spark, refs, [("pages", _table(spark, d, "pages").select(*own)), ("sources", _table(spark, d, "sources").select(*own))], O.even_cuts(links, "recorded_at", 3))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """References to pages or sources that are missing, deleted or arrived later."""
    return _orphans(spark, d).current().select("table_name", "field_name", "row_no", "kind", "ref_month")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Open references per table, field, month and kind."""
    return _orphans(spark, d).snapshot()


QUERIES = {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_paths": p2_paths, "p6_found": p6_found, "p6_counts": p6_counts}

_NORMAL = r"""regexp_replace(concat(regexp_replace(lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1)), ':443$', ''),
  substr({0}, length(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1)) + 1)), '/$', '')"""

_NODES = f"""
WITH RECURSIVE raw AS (SELECT url, regexp_replace(trim(url), '#.*$', '') u, CASE WHEN trim(parent_url) <> '' THEN regexp_replace(trim(parent_url), '#.*$', '') END p, depth, fetched_at FROM crawl_pages WHERE trim(url) <> ''),
keyed AS (SELECT {_NORMAL.format("u")} AS key, {_NORMAL.format("p")} AS parent, url, depth, fetched_at FROM raw),
one AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY CAST(fetched_at AS TIMESTAMPTZ) DESC, fetched_at DESC, url DESC, parent DESC NULLS LAST, depth DESC NULLS LAST) = 1),
node AS (SELECT a.key, a.url, a.depth, b.key AS pkey FROM one a LEFT JOIN one b ON a.parent = b.key),
"""

_CANON = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"
_P6 = f"""
WITH refs AS (
  SELECT DISTINCT 'links' AS table_name, 'from_id' AS field_name, link_no AS row_no, 'pages' AS target, {_CANON.format("from_id")} AS key, recorded_at FROM links
  UNION SELECT DISTINCT 'links', 'to_id', link_no, 'pages', {_CANON.format("to_id")}, recorded_at FROM links
  UNION SELECT DISTINCT 'page_sources', 'source_id', row_no, 'sources', {_CANON.format("source_id")}, recorded_at FROM page_sources),
par AS (
  SELECT 'pages' AS target, {_CANON.format("id")} AS key, min(recorded_at) AS first_at, bool_or(deleted_at IS NULL) AS live FROM pages GROUP BY ALL
  UNION ALL SELECT 'sources', {_CANON.format("id")}, min(recorded_at), bool_or(deleted_at IS NULL) FROM sources GROUP BY ALL),
found AS (
  SELECT table_name, field_name, row_no, CASE WHEN live IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN first_at > recorded_at THEN 'late' END AS kind,
    strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS ref_month
  FROM refs LEFT JOIN par USING (target, key) WHERE key <> '')
"""

ORACLE = {
    "p2_found": _NODES
    + """walk AS (SELECT key AS start, key AS now, 0 AS steps FROM node UNION ALL SELECT w.start, n.pkey, w.steps + 1 FROM walk w JOIN node n ON w.now = n.key WHERE n.pkey IS NOT NULL AND w.steps <= (SELECT count(*) FROM node)),
ended AS (SELECT w.start, w.now AS root, w.steps FROM walk w JOIN node n ON w.now = n.key WHERE n.pkey IS NULL),
endless AS (SELECT key FROM node WHERE key NOT IN (SELECT start FROM ended)),
on_cycle AS (SELECT DISTINCT start AS key FROM walk WHERE steps > 0 AND now = start),
low AS (SELECT e.key, min(n.url) AS root_url FROM endless e JOIN walk w ON w.start = e.key JOIN on_cycle c ON c.key = w.now JOIN node n ON n.key = w.now GROUP BY e.key)
SELECT n.url, r.url AS root_url, CAST(e.steps AS BIGINT) AS real_depth FROM node n JOIN ended e ON e.start = n.key JOIN node r ON r.key = e.root WHERE n.depth IS NOT NULL AND n.depth <> e.steps
UNION ALL SELECT n.url, low.root_url, CAST(-1 AS BIGINT) FROM low JOIN node n USING (key)""",
    "p2_paths": _NODES
    + """tree AS (SELECT key AS root, key, 0 AS steps, url AS path FROM node WHERE pkey IS NULL UNION ALL SELECT t.root, n.key, t.steps + 1, t.path || ' > ' || n.url FROM tree t JOIN node n ON n.pkey = t.key),
up AS (SELECT key AS start, key AS now FROM tree UNION ALL SELECT u.start, n.pkey FROM up u JOIN node n ON n.key = u.now WHERE n.pkey IS NOT NULL),
below AS (SELECT now AS key, count(*) - 1 AS descendants FROM up GROUP BY now)
SELECT n.url, r.url AS root_url, CAST(t.steps AS BIGINT) AS real_depth, b.descendants, t.path FROM tree t JOIN node n USING (key) JOIN node r ON r.key = t.root JOIN below b USING (key)""",
    "p6_found": _P6 + "SELECT * FROM found WHERE kind IS NOT NULL",
    "p6_counts": _P6 + "SELECT table_name, field_name, ref_month, kind, count(*) AS refs FROM found WHERE kind IS NOT NULL GROUP BY ALL",
}
