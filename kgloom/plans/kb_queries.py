"""Queries of decisions, records, merges and sidecars with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import decisions as D
from ..operators import graph as G
from ..operators import ontology, quality, records, web
from ..operators.orphans import canonical_id
from ..queries_core import _NODES, _NORMAL, CRAWL
from .queries import _C, _GRAPH, _PAGE, _claims_sql, CUTOFF, MANIFEST, ORACLE as _BASE, decisions_from_audit, freshness_warnings, t

EARLY = "2024-01-10"


def inbound_degree(s: SparkSession, d: str) -> DataFrame:
    """Links to each id."""
    return quality.inbound(G.edges(t(s, d, "links"), t(s, d, "pages")))


def page_hashes(s: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each page's body."""
    return t(s, d, "pages").select("id", F.sha2("body", 256).alias("content_hash")).distinct()


def merged_bodies(s: SparkSession, d: str) -> DataFrame:
    """The bodies of all spellings of an id as one."""
    return quality.merged_bodies(t(s, d, "pages")).select("key", "bodies", F.sha2("body", 256).alias("body_hash"))


def flagged_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages that are stale or take part in a contradiction."""
    claim = C.claims(t(s, d, "pages").where("type in ('Concept', 'Customer')"))
    return quality.flagged(freshness_warnings(s, d), C.contradicting(claim).select(canonical_id(F.col("key")).alias("key")))


def _decisions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Decision pages with the ids they affect or are justified by."""
    node, edge = G.nodes(t(s, d, "pages")), G.edges(t(s, d, "links"))
    own = node.where("type = 'Decision'").select(F.col("key").alias("id"), F.col("updated").alias("ts"), F.lit("review_flag").alias("decision_class"), (F.col("confidence") >= 0.5).alias("approved"), (F.size("sources") > 0).alias("ok"))
    return own, edge.select(F.col("src").alias("id"), "dst", "type")


def _targets(s: SparkSession, d: str) -> list[str]:
    """The six ids that most links of decisions lead to."""
    _, link = _decisions(s, d)
    counts = link.where("type in ('affects', 'justified_by')").groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(6)
    return [r.dst for r in counts.collect()]


def precedent_overlap(s: SparkSession, d: str) -> DataFrame:
    """Decision pages by how many of several ids they share, their approval and outcome."""
    own, link = _decisions(s, d)
    return D.precedents_by_links(own, link, _targets(s, d), cls="review_flag", limit=25)


def precedent_counts(s: SparkSession, d: str) -> DataFrame:
    """Decision pages considered and those that share an id."""
    own, link = _decisions(s, d)
    hit = link.where(F.col("type").isin("affects", "justified_by") & F.col("dst").isin(_targets(s, d))).select("id").distinct().withColumn("hit", F.lit(1))
    return own.join(hit, "id", "left").agg(F.count("*").alias("considered"), F.count("hit").alias("matches"))


def decision_links(s: SparkSession, d: str) -> DataFrame:
    """What each audited decision affects, is approved and justified by."""
    own = decisions_from_audit(s, d).where("action in ('flag_error', 'flag_signup')")
    inputs = F.create_map(F.lit("target_entity"), F.col("entity"), F.lit("actor"), F.col("actor"), F.lit("name"), F.concat("action", F.lit(" "), "actor"), F.lit("page_id"), F.concat(F.lit("page-"), "actor"))
    return D.links_of_inputs(own.select("id", inputs.alias("inputs"), F.array("entity", F.lit("report")).alias("cites"), F.array("entity", "action").alias("flagged")))


def decision_classes(s: SparkSession, d: str) -> DataFrame:
    """Classes of decisions of all kinds of actions, with and without approval."""
    every = t(s, d, "events").where("event_type is not null").select(F.explode(F.array(*[F.concat(F.lit(p), "event_type") for p in ("flag_", "create_", "trigger_", "publish_", "run_", "drop_")])).alias("action"), (F.col("value") > 50).alias("approved"))
    return every.groupBy("action", D.full_class(F.col("action"), F.col("approved")).alias("decision_class")).agg(F.count("*").alias("decisions"))


def backfill_counts(s: SparkSession, d: str) -> DataFrame:
    """Audited decisions that a backfill writes where those before a day are there."""
    own = decisions_from_audit(s, d)
    return D.backfill_counts(own, own.where(F.col("ts") < EARLY))


def replay_buckets(s: SparkSession, d: str) -> DataFrame:
    """Live pages per object type at an instant, with types that have none."""
    return D.replay_report(t(s, d, "pages"), CUTOFF, ontology.OBJECT_TYPES)


def record_bodies(s: SparkSession, d: str) -> DataFrame:
    """The page of each record."""
    return records.bodies(t(s, d, "customer"), MANIFEST)


def record_overview(s: SparkSession, d: str) -> DataFrame:
    """Rows, complete rows and columns of a record table."""
    return records.overview(t(s, d, "customer"), MANIFEST)


def record_ingest(s: SparkSession, d: str) -> DataFrame:
    """Pages that a second run writes after balances below zero have changed."""
    rows = t(s, d, "customer")
    held = records.ingest(rows, MANIFEST, s.createDataFrame([], "id string, content_hash string"))
    changed = rows.withColumn("c_acctbal", F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal")))
    return records.ingest(changed, MANIFEST, held).select("id", "body")


def web_sidecars(s: SparkSession, d: str) -> DataFrame:
    """Web documents with their crawl rows."""
    return web.with_sidecars(t(s, d, "parsed_documents"), t(s, d, "crawl_pages").select(*CRAWL))


def raw_paths(s: SparkSession, d: str) -> DataFrame:
    """Paths of documents from their raw folder on."""
    return t(s, d, "parsed_documents").select(web.raw_relative(F.concat(F.lit("/data/"), "raw_path")).alias("path")).distinct()


def sources_in_order(s: SparkSession, d: str) -> DataFrame:
    """The first sources by time of publication, or else of update."""
    own = t(s, d, "sources").select("id", F.coalesce("published_at", "updated", F.lit("")).alias("at")).distinct()
    return own.orderBy("at", "id").limit(50)


_NAMES = """inbound_degree page_hashes merged_bodies flagged_pages precedent_overlap precedent_counts decision_links decision_classes backfill_counts replay_buckets record_bodies record_overview
record_ingest web_sidecars raw_paths sources_in_order""".split()

QUERIES = {n: globals()[n] for n in _NAMES}

# ---------------------------------------------------------------- SQL

_AUDIT = _BASE["decisions_from_audit"]
_DECIDED = f"""WITH {_GRAPH}, own AS (SELECT key AS id, updated AS ts, confidence >= 0.5 AS approved, len(sources) > 0 AS ok FROM node WHERE type = 'Decision'),
dl AS (SELECT src AS id, dst FROM (SELECT DISTINCT link_no, {_C.format("from_id")} AS src, {_C.format("to_id")} AS dst, type FROM links) WHERE src <> '' AND dst <> '' AND type IN ('affects', 'justified_by')),
target AS (SELECT dst FROM dl GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 6),
shared AS (SELECT id, count(DISTINCT dst) AS overlap FROM dl WHERE dst IN (SELECT dst FROM target) GROUP BY id)
"""
_CITE = "'customer.csv#key=' || c_custkey"
_ME = f"'customer_' || coalesce(nullif({_C.format('c_name')}, ''), 'row')"


def _record_sql(balance: str) -> str:
    cells = {"c_acctbal": f"CAST({balance} AS VARCHAR)", "c_custkey": "CAST(c_custkey AS VARCHAR)", "c_mktsegment": "c_mktsegment", "c_name": "c_name", "c_nationkey": "CAST(c_nationkey AS VARCHAR)"}
    bullets = " || ".join(f"CASE WHEN trim(coalesce({v}, '')) <> '' THEN chr(10) || '- **{c}**: ' || trim({v}) ELSE '' END" for c, v in cells.items())
    return f"SELECT {_ME} AS id, min('_Customer record imported from `' || {_CITE} || '`._' || chr(10) || {bullets}) AS body FROM customer WHERE trim(coalesce(c_name, '')) <> '' AND trim(coalesce(c_mktsegment, '')) <> '' GROUP BY 1"


ORACLE = {
    "inbound_degree": "WITH " + _GRAPH + " SELECT dst AS key, count(*) AS inbound, count(DISTINCT src) AS from_pages FROM edge GROUP BY dst",
    "page_hashes": "SELECT DISTINCT id, sha256(body) AS content_hash FROM pages",
    "merged_bodies": f"SELECT key, count(*) AS bodies, sha256(string_agg(body, chr(10) || chr(10) ORDER BY length(body) DESC, body)) AS body_hash FROM (SELECT DISTINCT {_C.format('id')} AS key, body FROM pages WHERE length(body) > 0) WHERE key <> '' GROUP BY key",
    "precedent_overlap": _DECIDED + "SELECT id, ts, coalesce(overlap, 0) AS overlap, CAST(3.0 * coalesce(overlap, 0) + 2.0 + CASE WHEN approved THEN 0.5 ELSE 0 END + CASE WHEN ok THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM own LEFT JOIN shared USING (id) ORDER BY score DESC, ts DESC, id LIMIT 25",
    "precedent_counts": _DECIDED + "SELECT count(*) AS considered, count(overlap) AS matches FROM own LEFT JOIN shared USING (id)",
    "decision_links": f"""WITH dec AS (SELECT * FROM ({_AUDIT}) WHERE action IN ('flag_error', 'flag_signup'))
SELECT id, entity AS dst, 'affects' AS type FROM dec WHERE entity IS NOT NULL UNION SELECT id, actor, 'approved_by' FROM dec WHERE actor IS NOT NULL UNION SELECT id, 'page-' || actor, 'affects' FROM dec WHERE actor IS NOT NULL
UNION SELECT id, entity, 'justified_by' FROM dec WHERE entity IS NOT NULL UNION SELECT id, 'report', 'justified_by' FROM dec UNION SELECT id, action, 'affects' FROM dec""",
    "decision_classes": """WITH x AS (SELECT p || event_type AS action, p, value > 50 AS approved FROM events, (VALUES ('flag_'), ('create_'), ('trigger_'), ('publish_'), ('run_'), ('drop_')) v(p) WHERE event_type IS NOT NULL)
SELECT action, CASE p WHEN 'flag_' THEN 'review_flag' WHEN 'publish_' THEN 'publication' WHEN 'run_' THEN 'synthesis' WHEN 'drop_' THEN 'other' ELSE 'operational_write' || CASE WHEN coalesce(approved, false) THEN '_approved' ELSE '_unapproved' END END AS decision_class, count(*) AS decisions FROM x GROUP BY ALL""",
    "backfill_counts": f"SELECT count(*) AS considered, count(*) FILTER (WHERE ts >= '{EARLY}') AS written, count(*) FILTER (WHERE ts < '{EARLY}') AS skipped FROM ({_AUDIT})",
    "flagged_pages": f"""WITH {_claims_sql("type IN ('Concept', 'Customer')")},
grp AS (SELECT kind, period, segment FROM claim WHERE kind NOT IN ('percent', 'usd_billion', 'usd_million') OR (segment <> 'company_wide' AND period <> 'unspecified') GROUP BY ALL HAVING count(DISTINCT (value, unit)) > 1)
SELECT key FROM ({_BASE["freshness_warnings"]}) UNION SELECT {_C.format("id")} FROM claim SEMI JOIN grp USING (kind, period, segment)""",
    "replay_buckets": f"""WITH {_PAGE}, p AS (SELECT *, coalesce(CASE WHEN regexp_matches(updated, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(updated AS TIMESTAMPTZ) END, recorded_at) AS seen FROM page),
l AS (SELECT *, coalesce(seen <= TIMESTAMPTZ '{CUTOFF}+00', true) AND (deleted_at IS NULL OR deleted_at > TIMESTAMPTZ '{CUTOFF}+00') AS live FROM p)
SELECT b.bucket, count(*) FILTER (WHERE live) AS live, count(id) AS total, max(strftime(recorded_at, '%Y-%m-%d %H:%M:%S')) FILTER (WHERE live) AS newest
FROM (VALUES {", ".join(f"('{x}')" for x in ontology.OBJECT_TYPES)}) b(bucket) LEFT JOIN l ON l.type = b.bucket GROUP BY b.bucket""",
    "record_bodies": _record_sql("c_acctbal"),
    "record_overview": "SELECT (SELECT count(*) FROM customer) AS rows, count(*) AS complete, 'c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey' AS columns FROM customer WHERE trim(coalesce(c_name, '')) <> '' AND trim(coalesce(c_mktsegment, '')) <> ''",
    "record_ingest": f"SELECT * FROM ({_record_sql('CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END')}) EXCEPT SELECT * FROM ({_record_sql('c_acctbal')})",
    "web_sidecars": _NODES
    + f"""doc AS (SELECT DISTINCT raw_path, metadata['url'] AS url FROM parsed_documents WHERE metadata['url'] IS NOT NULL),
bare AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM doc), k AS (SELECT *, {_NORMAL.format("u")} AS k FROM bare)
SELECT raw_path, k.url, regexp_extract(k, '^[^:]+://([^/?#]+)', 1) AS host, node.depth FROM k LEFT JOIN node ON node.key = k.k""",
    "raw_paths": "SELECT DISTINCT raw_path AS path FROM parsed_documents",
    "sources_in_order": "SELECT DISTINCT id, coalesce(published_at, updated, '') AS \"at\" FROM sources ORDER BY \"at\", id LIMIT 50",
}
