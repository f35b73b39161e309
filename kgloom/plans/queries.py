"""The engine's operators as named queries over the tables, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from ..operators import decisions as D
from ..operators import graph as G
from ..operators import memo as M
from ..operators import kb, ontology, quality, records, retrieval, web
from ..operators.orphans import canonical_id
from ..sources import sinks
from ..streaming import logs
from .materialize import shared_dir

QUESTION = "What revenue and gross margin did the storage division report in fiscal 2026"
REPEATED = "supply assurance supply relay"
FTS = "export control relay"
AS_OF = "2031-06-01"
CUTOFF = "2030-06-01 00:00:00"

MANIFEST = {
    "target_type": "Customer",
    "identity": "customer_{c_name|slug}",
    "name": "c_name",
    "required": ["c_name", "c_mktsegment"],
    "citation": "customer.csv#key={c_custkey|raw}",
    "links": [
        {"to": "segment_{c_mktsegment|slug}", "to_type": "Concept", "name": "c_mktsegment", "type": "operates_in"},
        {"to": "nation_{c_nationkey|raw}", "to_type": "Concept", "name": "c_nationkey", "type": "part_of", "from_other": True},
    ],
}


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = t(s, d, "pages")
    return G.nodes(pages), G.edges(t(s, d, "links"), pages)


def _seed(s: SparkSession, node: DataFrame) -> DataFrame:
    """The smallest key of each object type: seven at most."""
    return node.groupBy("type").agg(F.min("key").alias("key")).select("key")


def bm25_topk(s, d):
    return kb.bm25(t(s, d, "documents"), "doc_id", "text", QUESTION)


def bm25_repeated_terms(s, d):
    return kb.bm25(t(s, d, "documents"), "doc_id", "text", REPEATED, top_k=20)


def bm25_pages(s, d):
    return kb.bm25(t(s, d, "pages"), "id", "body", QUESTION, top_k=None)


def _fts(s, d):
    return retrieval.fts_documents(t(s, d, "pages"), t(s, d, "parsed_documents"))


def fts_rank_filtered(s, d):
    return retrieval.fts_rank(_fts(s, d), FTS, types=["Concept", "Product"], limit=15)


def fts_tagged(s, d):
    return retrieval.fts_rank(_fts(s, d), FTS, tags=["networking"], limit=15)


def fts_porter_rank(s, d):
    return retrieval.fts_rank(_fts(s, d), "controls relays exported", limit=15, stem=retrieval.Porter())


def seed_resolution(s, d):
    return retrieval.seeds(retrieval.fts_rank(_fts(s, d), FTS, limit=15), t(s, d, "sources"), 5)


def answer_contexts(s, d):
    pages = t(s, d, "pages")
    return retrieval.contexts(pages, G.edges(t(s, d, "links")), kb.bm25(pages, "id", "body", QUESTION))


def graph_nodes(s, d):
    return _graph(s, d)[0].select("key", "id", "type", F.size("sources").alias("n_sources"), "confidence", "updated")


def graph_edges(s, d):
    return _graph(s, d)[1].groupBy("type", "origin").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


def ontology_conformance(s, d):
    node, edge = _graph(s, d)
    return G.conformance(edge, node, ontology.link_types(s)).groupBy("type", "error").agg(F.count("*").alias("edges"))


def edges_resolved(s, d):
    node, edge = _graph(s, d)
    return G.resolved(edge, node).groupBy("src", "type").agg(F.count("*").alias("edges"))


def bfs_hops(s, d):
    node, edge = _graph(s, d)
    return G.traverse(edge.where("origin = 'frontmatter'"), node, _seed(s, node), 2)


def expand_outgoing(s, d):
    node, edge = _graph(s, d)
    return G.traverse(edge.where("origin = 'frontmatter'"), node, _seed(s, node), 2, both=False).select("key")


def typed_pattern(s, d):
    node, edge = _graph(s, d)
    return G.pattern(edge, node, "Memo", "cites_evidence", "Concept").unionByName(G.pattern(edge, node, "Decision", "justified_by", "Memo"))


def coverage_by_type(s, d):
    node, edge = _graph(s, d)
    return G.coverage(bfs_hops(s, d), node, ontology.object_types(s))


def provenance_chain(s, d):
    node, _ = _graph(s, d)
    return G.provenance(bfs_hops(s, d), node, t(s, d, "sources"))


def freshness_warnings(s, d):
    return quality.freshness(_graph(s, d)[0], t(s, d, "sources"))


def numeric_claims(s, d):
    return C.claims(t(s, d, "pages"))


def _claims(s, d):
    return C.claims(t(s, d, "pages").where("type in ('Concept', 'Customer')"))


def contradictions(s, d):
    return C.contradictions(_claims(s, d))


def metric_rollup(s, d):
    return C.rollup(C.claims(t(s, d, "pages")))


def numeric_completeness(s, d):
    return C.completeness(t(s, d, "parsed_documents"), t(s, d, "sources"), t(s, d, "pages"))


def lint_report(s, d):
    node, edge = _graph(s, d)
    return quality.lint(node, edge, AS_OF, t(s, d, "pages"))


def lint_counts(s, d):
    return quality.lint_counts(lint_report(s, d), numeric_completeness(s, d))


def source_inventory(s, d):
    return quality.inventory(t(s, d, "sources"), t(s, d, "page_sources"), t(s, d, "parsed_documents"))


def kind_counts(s, d):
    node, edge = _graph(s, d)
    prov = node.select(F.explode("sources"))
    one = lambda df, k: df.agg(F.count("*").alias("records")).select(F.lit(k).alias("kind"), "records")
    return one(node, "node").unionByName(one(edge, "edge")).unionByName(one(prov, "provenance"))


def _spelled(s, d):
    return quality.spellings(t(s, d, "pages"), t(s, d, "links"))


def duplicate_ids(s, d):
    return quality.duplicates(_spelled(s, d))


def merge_winners(s, d):
    return quality.winners(_spelled(s, d), t(s, d, "pages"))


def rewritten_links(s, d):
    return quality.rewrite(t(s, d, "links"), merge_winners(s, d))


def merged_sources(s, d):
    return quality.union_sources(t(s, d, "pages")).select("key", F.array_join("sources", ",").alias("sources"))


def record_entities(s, d):
    return records.entities(t(s, d, "customer"), MANIFEST)


def record_links(s, d):
    return records.links(t(s, d, "customer"), MANIFEST)


def record_content_hash(s, d):
    return records.exact_content_hash(t(s, d, "nation"))


def table_fingerprint(s, d):
    return records.content_hash(t(s, d, "customer"))


def slugs(s, d):
    return t(s, d, "pages").groupBy("id").agg(F.min("title").alias("t")).select("id", T.slug_letters("t").alias("letters"), T.slug_ascii("t").alias("ascii"), T.slug_blank("t").alias("blank"))


def url_slugs(s, d):
    return t(s, d, "crawl_pages").select("url").distinct().select("url", T.url_slug("url").alias("slug"))


def _html(s, d):
    """Pages as HTML: title and body, a paragraph for each line and a link for each wikilink, with chrome around and between them."""
    body = F.coalesce("p.body", F.lit(""))
    for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        body = F.replace(body, F.lit(x), F.lit(y))
    body = F.regexp_replace(body, r"\[\[([a-zA-Z0-9_-]+)\]\]", "<a class='ref' href='../wiki/$1#top'>$1</a>")
    lines = F.transform(F.split(body, "\n"), lambda x: F.concat(F.lit("<div><p class=\"line\">"), x, F.lit("</p></div>")))
    head = "<html><head><style>b{}</style></head><body><nav><a href='/home'>Home</a></nav><h1>"
    return t(s, d, "pages").groupBy("id").agg(F.min(F.struct("title", "body")).alias("p")).select(
        F.concat(F.lit("https://kb.example/wiki/"), "id").alias("url"),
        F.concat(F.lit(head), "p.title", F.lit("</h1><p>See <a href='/wiki/"), "id", F.lit("'>self</a>, <a href=\"up#top\">up</a> &amp; <a href='mailto:x@y.example'>mail</a>.</p><div class='share'>Share</div>"), F.array_join(lines, ""), F.lit("<footer>end</footer></body></html>")).alias("html"),
    )


def html_text(s, d):
    return _html(s, d).select("url", web.text(F.col("html")).alias("text"))


def html_links(s, d):
    return web.links(_html(s, d))


def crawl_frontier(s, d):
    pages = t(s, d, "crawl_pages")
    return G.frontier(pages, pages.where("parent_url is null").select("url"), 3)


def heading_sections(s, d):
    return web.heading_sections(t(s, d, "pages"), "id", "body")


def paragraph_chunks(s, d):
    return web.paragraph_chunks(t(s, d, "pages"), "id", "body")


def titles_summaries(s, d):
    return web.index_entries(t(s, d, "pages")).select("id", "title", "summary")


def first_sentences(s, d):
    return web.index_entries(t(s, d, "pages")).select("id", "opening")


def wikilinks(s, d):
    return t(s, d, "pages").select("id", "body").dropDuplicates(["id"]).select("id", F.posexplode(T.wikilinks("body")).alias("n", "target"))


def catalog(s, d):
    return quality.catalog(t(s, d, "pages")).select("ord", "type", "sort_title", "id")


def decisions_from_audit(s, d):
    return D.from_events(t(s, d, "events"))


def precedent_search(s, d):
    return D.precedents(decisions_from_audit(s, d), ["entity_7", "entity_9"], cls="review_flag", limit=10)


def precedent_for(s, d):
    return D.precedents(decisions_from_audit(s, d), ["entity_3"], action="flag_error", hard=False, limit=10, exclude="decision_flag_view_u7_202401010006291662")


def replay_live_pages(s, d):
    return D.replay(t(s, d, "pages"), CUTOFF)


def replay_prior_decisions(s, d):
    return decisions_from_audit(s, d).where(F.col("ts") <= "2024-01-10").orderBy(F.desc("ts"), "id").limit(20).select("id", "ts")


def review_queue_dedup(s, d):
    return D.review_queue(t(s, d, "events")).select("concept_id", "reason")


def review_queue_stream(s, d):
    """The streaming twin, run over the table as a stream to its end."""
    import uuid

    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    stream = s.readStream.schema(t(s, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, so that one file may be streamed
    q = logs.review_queue(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema("concept_id string, reason string").parquet(f"{base}/out")


def events_windowed(s, d):
    return logs.windowed(t(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "value")


def graph_export_nodes(s, d):
    return G.graphml_nodes(_graph(s, d)[0])


def snapshot_roundtrip(s, d):
    import uuid

    node, edge = _graph(s, d)
    path = f"{shared_dir(s)}/snapshot-{uuid.uuid4().hex}"
    sinks.snapshot({"node": node.select("key", "type"), "edge": edge.withColumnRenamed("type", "link")}, path)
    return s.read.schema("kind string, key string, type string, src string, dst string, link string, origin string").json(path).groupBy("kind", F.coalesce("type", "link").alias("type")).agg(F.count("*").alias("records"))


def source_references(s, d):
    """References of pages to sources per canonical source id."""
    return D.sources_of(t(s, d, "pages")).groupBy(canonical_id(F.col("source")).alias("key")).agg(F.count("*").alias("citations"))


def trace_kinds(s, d):
    """Chunk kinds and sizes of the parsed documents, by provider."""
    own = t(s, d, "parsed_documents").select("raw_path", F.coalesce("provider", F.lit("none")).alias("provider"), F.explode("chunks").alias("c")).select("raw_path", "provider", "c.type", F.length("c.markdown").alias("chars"))
    return own.groupBy("provider", "type").agg(F.count_distinct("raw_path").alias("documents"), F.max("chars").alias("longest"))


def memo_summary(s, d):
    """Memo of the first customer, two hops."""
    pages = t(s, d, "pages")
    seed = G.nodes(pages.where("type = 'Customer'")).agg(F.min("key").alias("key"))
    return M.summary(M.build(pages, t(s, d, "links"), t(s, d, "sources"), seed))


_NAMES = """bm25_topk bm25_repeated_terms bm25_pages fts_rank_filtered fts_tagged fts_porter_rank seed_resolution answer_contexts graph_nodes graph_edges ontology_conformance
edges_resolved bfs_hops expand_outgoing typed_pattern coverage_by_type provenance_chain freshness_warnings numeric_claims contradictions metric_rollup numeric_completeness
lint_report lint_counts source_inventory kind_counts duplicate_ids merge_winners rewritten_links merged_sources record_entities record_links record_content_hash table_fingerprint slugs url_slugs
html_text html_links crawl_frontier heading_sections paragraph_chunks titles_summaries first_sentences wikilinks catalog decisions_from_audit precedent_search precedent_for
replay_live_pages replay_prior_decisions review_queue_dedup review_queue_stream events_windowed graph_export_nodes snapshot_roundtrip source_references trace_kinds memo_summary""".split()

QUERIES = {n: globals()[n] for n in _NAMES}

# ---------------------------------------------------------------- SQL

_C = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"
_PAGE = "page AS (SELECT DISTINCT * FROM pages)"
_JSON = "coalesce(TRY_CAST({0} AS JSON)::VARCHAR[], [])"


def _bm25_sql(table: str, key: str, text: str, question: str, limit: str) -> str:
    terms = retrieval.query_terms(question)
    q = ", ".join(f"('{w}', {n})" for w, n in terms.items())
    return f"""
WITH src AS (SELECT DISTINCT {key} AS k, {text} AS b FROM {table}),
tok AS (SELECT k, list_transform(regexp_extract_all(coalesce(b, ''), '[a-zA-Z][a-zA-Z0-9_]+'), lambda x: lower(x)) AS t FROM src),
q(term, mult) AS (VALUES {q}),
stat AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT k, len(t) AS dl, term, mult, len(list_filter(t, lambda x: x = term)) AS tf FROM tok, q),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term)
SELECT k AS {key}, round(sum(mult * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))), 6) AS score
FROM tf JOIN df USING (term), stat GROUP BY k HAVING score > 0 ORDER BY score DESC, {key} {limit}"""


_GRAPH = f"""
{_PAGE},
node AS (SELECT key, r.id, r.type, r.path, r.sources, r.confidence, r.updated FROM (
  SELECT {_C.format("id")} AS key, arg_min({{'id': id, 'type': type, 'path': path, 'sources': {_JSON.format("source_ids")}, 'confidence': coalesce(confidence, 0.5), 'updated': coalesce(updated, '')}}, id) AS r
  FROM page WHERE {_C.format("id")} <> '' GROUP BY 1)),
link AS (SELECT DISTINCT * FROM links),
wl AS (SELECT id, unnest(regexp_extract_all(body, '\\[\\[([^\\]|#]+)(?:[|#][^\\]]*)?\\]\\]', 1)) AS target FROM page WHERE type = 'Source'),
edge0 AS (SELECT {_C.format("from_id")} AS src, {_C.format("to_id")} AS dst, type, 'frontmatter' AS origin FROM link
  UNION ALL SELECT {_C.format("id")}, {_C.format("target")}, 'mentions', 'wikilink' FROM wl),
edge AS (SELECT * FROM edge0 WHERE src <> '' AND dst <> '')"""

_BFS = """,
seed AS (SELECT min(key) AS key FROM node GROUP BY type),
step AS (SELECT src, dst FROM edge WHERE origin = 'frontmatter'{both}),
h1 AS (SELECT DISTINCT dst AS key FROM step SEMI JOIN seed ON src = seed.key WHERE dst IN (SELECT key FROM node) AND dst NOT IN (SELECT key FROM seed)),
h2 AS (SELECT DISTINCT dst AS key FROM step SEMI JOIN h1 ON src = h1.key WHERE dst IN (SELECT key FROM node) AND dst NOT IN (SELECT key FROM seed) AND dst NOT IN (SELECT key FROM h1)),
bfs AS (SELECT key, 0 AS hop FROM seed UNION ALL SELECT key, 1 FROM h1 UNION ALL SELECT key, 2 FROM h2)"""
_BOTH = _BFS.format(both=" UNION ALL SELECT dst, src FROM edge WHERE origin = 'frontmatter'")
_OUT = _BFS.format(both="")

_SPECS = "spec(type, dom, ran) AS (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in ontology.LINK_TYPES.items()) + ")"


def _claims_sql(where: str = "true") -> str:
    def case(table, default):
        return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(ctx, '{h}')" for h in hints) + f" THEN '{n}'" for n, hints in table) + f" ELSE '{default}' END"

    kinds = "CASE " + " ".join(f"WHEN unit = '{u}' THEN " + case([(k, [h]) for k, h in tab if h] or [("never", ["\x03"])], tab[-1][0]) for u, tab in C.KINDS.items()) + " END"
    pats = ", ".join(f"('{u}', '{p}')" for u, p in (("%", C.PERCENT), ("USD_B", C.BILLION), ("USD_M", C.MILLION)))
    return f"""
pb AS (SELECT DISTINCT id, body, type FROM pages WHERE body IS NOT NULL AND {where}),
pat(unit, re) AS (VALUES {pats}),
sp AS (SELECT id, body, unit, m, p FROM (
  SELECT id, body, '%' AS unit, regexp_extract_all(body, '{C.PERCENT}') AS m, regexp_split_to_array(body, '{C.PERCENT}') AS p FROM pb
  UNION ALL SELECT id, body, 'USD_B', regexp_extract_all(body, '{C.BILLION}'), regexp_split_to_array(body, '{C.BILLION}') FROM pb
  UNION ALL SELECT id, body, 'USD_M', regexp_extract_all(body, '{C.MILLION}'), regexp_split_to_array(body, '{C.MILLION}') FROM pb)),
one AS (SELECT id, body, unit, m, p, unnest(range(1, len(m) + 1)) AS i FROM sp),
pos AS (SELECT id, body, unit, m[i] AS hit, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM one),
ctx AS (SELECT id, unit, start, CAST(regexp_extract(hit, '{C.NUMBER}') AS DOUBLE) AS value, lower(substr(body, greatest(start - 80, 0) + 1, start + length(hit) + 40 - greatest(start - 80, 0))) AS ctx FROM pos),
claim AS (SELECT id, start, {kinds} AS kind, value, unit, {case(C.PERIODS, "unspecified")} AS period, {case(C.SEGMENTS, "company_wide")} AS segment FROM ctx)"""


def _fts_sql(query: str, where: str, limit: int) -> str:
    import re

    words = sorted({w.lower() for w in re.findall(r"[A-Za-z0-9]+", query)})
    q = ", ".join(f"('{w}')" for w in words)
    return f"""
{_PAGE},
doc AS (SELECT raw_path, any_value(chunks) AS chunks FROM parsed_documents GROUP BY raw_path),
ch AS (SELECT raw_path, i, chunks[i] AS c FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM doc)),
fts AS (SELECT 'page' AS kind, id AS row_id, type, {_JSON.format("source_ids")}[1] AS source_id, path, title, coalesce(tags, '') AS tags, body AS content FROM page
  UNION ALL SELECT 'chunk', raw_path || '#' || cid, c.type, raw_path, raw_path, '', '', c.markdown FROM (SELECT raw_path, coalesce(c.id, '#' || (i - 1)) AS cid, arg_max(c, i) AS c FROM ch GROUP BY 1, 2)),
tok AS (SELECT kind, row_id, type, source_id, tags, list_transform(regexp_extract_all(concat_ws(' ', kind, row_id, type, source_id, path, title, tags, content), '[A-Za-z0-9]+'), lambda x: lower(x)) AS t FROM fts),
q(term) AS (VALUES {q}),
stat AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT kind, row_id, type, source_id, tags, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM tok, q),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
hits AS (SELECT row_id, kind, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS rank
FROM tf JOIN df USING (term), stat WHERE {where} GROUP BY row_id, kind HAVING sum(tf) > 0 ORDER BY rank, row_id LIMIT {limit})"""


_ISO = "CASE WHEN regexp_matches({0}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(substr({0}, 1, 10) AS DATE) END"
_SPELL = f"""
{_PAGE},
uses AS (SELECT DISTINCT id FROM page UNION ALL SELECT from_id FROM (SELECT DISTINCT * FROM links) UNION ALL SELECT to_id FROM (SELECT DISTINCT * FROM links)),
spelled AS (SELECT {_C.format("id")} AS key, id, count(*) AS uses FROM uses WHERE id IS NOT NULL GROUP BY ALL HAVING key <> ''),
pg AS (SELECT id, max(length(coalesce(body, ''))) AS len, max(coalesce(confidence, 0.5)) AS conf FROM page GROUP BY id),
winner AS (SELECT key, id AS winner FROM spelled LEFT JOIN pg USING (id) QUALIFY row_number() OVER (PARTITION BY key ORDER BY len IS NULL, len DESC, conf DESC, uses DESC, id) = 1)"""
_TITLE = "CASE WHEN trim(regexp_extract(coalesce(body, ''), '(?m)^# (.*)$', 1)) <> '' THEN trim(regexp_extract(coalesce(body, ''), '(?m)^# (.*)$', 1)) ELSE array_to_string(list_transform(string_split(replace(id, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') END"
_LINES = "array_to_string(list_filter(list_transform(string_split(coalesce(body, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '```')), ' ')"
_DEC = """dec AS (SELECT 'decision_flag_' || event_type || '_u' || user_id || '_' || substr(regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '[^0-9]', '', 'g'), 1, 18) AS id,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, 'u' || user_id AS actor, 'flag_' || event_type AS action, 'review_flag' AS decision_class, 'entity_' || CAST(json_extract_string(props, '$.k') AS BIGINT) AS entity, value FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, actor, action, entity, value) = 1)"""
_NORM = r"""regexp_replace(concat(regexp_replace(lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1)), ':443$', ''),
  substr({0}, length(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1)) + 1)), '/$', '')"""
_HTMLS = "htm AS (SELECT DISTINCT 'https://kb.example/wiki/' || id AS url, id, title, body FROM pages)"

def _even(x: str, digits: int) -> str:
    """``x``, a decimal of at least 0, as text with so many digits, halves to even; with -2 digits to hundreds."""
    unit = 10 ** max(digits, 0)
    y = f"({x}) * {unit}" if digits >= 0 else f"({x}) / {10 ** -digits}"
    low, rest = f"CAST(floor({y}) AS HUGEINT)", f"(({y}) - floor({y}))"
    n = f"({low} + CASE WHEN {rest} > 0.5 OR ({rest} = 0.5 AND {low} % 2 = 1) THEN 1 ELSE 0 END)"
    if digits <= 0:
        return f"CAST({n} * {10 ** -digits} AS VARCHAR)"
    return f"CAST({n} // {unit} AS VARCHAR) || '.' || lpad(CAST({n} % {unit} AS VARCHAR), {digits}, '0')"


_FIGURES = " UNION ALL ".join(
    f"SELECT raw_path, n, '{k}' AS kind, regexp_extract_all(line, '{x}', 1) AS r FROM line"
    for k, x in {
        "usd_billion": r"(?i)\$\s*(\d{1,3}(?:[,.]\d{1,3})*(?:\.\d+)?)\s*(?:billion|(?:B|bn)(?:[^\p{L}\p{N}_]|$))",
        "usd_million": r"(?i)\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(?:million|(?:M|mn)(?:[^\p{L}\p{N}_]|$))",
        "usd_table": r"\$\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?)",
        "percent": r"(?:^|[^A-Za-z0-9])(\d{1,3}(?:\.\d+)?)[ \t]*%",
    }.items()
)
_COMPLETE = f"""
WITH {_PAGE}, src AS (SELECT DISTINCT {_C.format("id")} AS skey, raw_path FROM sources WHERE raw_path <> ''),
cite AS (SELECT unnest(list_distinct(list_transform({_JSON.format("source_ids")}, lambda x: {_C.format("x")}))) AS skey,
  list_concat(regexp_extract_all(coalesce(body, ''), '\\d+(?:\\.\\d+)?'), regexp_extract_all(coalesce(body, ''), '\\d+(?:[,.]\\d+)*')) AS held FROM page),
cited AS (SELECT raw_path, held FROM cite JOIN src USING (skey)),
held AS (SELECT DISTINCT raw_path, unnest(held) AS form FROM cited),
doc AS (SELECT raw_path, any_value(markdown) AS markdown FROM parsed_documents WHERE markdown IS NOT NULL AND raw_path IN (SELECT raw_path FROM cited) GROUP BY raw_path),
line AS (SELECT raw_path, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS n FROM doc),
num AS (SELECT raw_path, kind, n, unnest(r) AS raw, generate_subscripts(r, 1) AS p FROM ({_FIGURES})),
val AS (SELECT *, replace(raw, ',', '') AS plain, TRY_CAST(replace(raw, ',', '') AS DECIMAL(24, 9)) AS v FROM num),
form AS (SELECT raw_path, kind, n, p, list_filter(list_distinct([raw, plain] || CASE
    WHEN kind = 'percent' THEN [{_even("v", 1)}, {_even("v", 2)}, CASE WHEN v = floor(v) THEN CAST(CAST(floor(v) AS HUGEINT) AS VARCHAR) END]
    WHEN kind = 'usd_billion' THEN [CAST(CAST(floor(v * 1000) AS HUGEINT) AS VARCHAR), {_even("v * 1000", -2)}, {_even("v * 1000", 0)}]
    ELSE [{_even("v / 1000", 3)}, {_even("v / 1000", 2)}, {_even("v / 1000", 1)}] END), lambda x: length(x) >= 3) AS f FROM val WHERE v IS NOT NULL),
hit AS (SELECT f.raw_path, kind, n, p, bool_or(h.form IS NOT NULL) AS there FROM (SELECT raw_path, kind, n, p, unnest(f) AS form FROM form) f LEFT JOIN held h ON h.raw_path = f.raw_path AND h.form = f.form GROUP BY ALL)
SELECT raw_path, count(*) AS numerics, count(*) FILTER (WHERE NOT there) AS missing FROM hit GROUP BY raw_path HAVING missing > 0"""

_LINT = "WITH " + _GRAPH + f""", ty AS (SELECT *, {_ISO.format("updated")} AS dt FROM node)
SELECT key, 'bad_date' AS rule, updated AS value FROM ty WHERE dt IS NULL UNION ALL SELECT key, 'stale', updated FROM ty WHERE date_diff('day', dt, DATE '{AS_OF}') > 180
UNION ALL SELECT key, 'no_sources', '' FROM ty WHERE len(sources) = 0 AND type <> 'Source' UNION ALL SELECT key, 'unknown_type', coalesce(type, '') FROM ty WHERE coalesce(type, '') NOT IN {ontology.OBJECT_TYPES}
UNION ALL SELECT * FROM (SELECT DISTINCT src, 'broken_link', dst FROM edge WHERE dst NOT IN (SELECT key FROM node) AND src IN (SELECT key FROM node))
UNION ALL SELECT * FROM (SELECT DISTINCT src, 'unknown_link_type', coalesce(type, '') FROM edge WHERE origin = 'frontmatter' AND coalesce(type, '') NOT IN {tuple(ontology.LINK_TYPES)} AND src IN (SELECT key FROM node))
UNION ALL SELECT * FROM (SELECT DISTINCT coalesce(path, ''), 'missing_frontmatter', '' FROM pages WHERE coalesce({_C.format("id")}, '') = '' OR (type IS NULL AND source_ids IS NULL))
UNION ALL SELECT key, 'orphan', '' FROM ty WHERE type <> 'Source' AND len(list_filter(sources, lambda x: starts_with(x, 'action:'))) = 0 AND key NOT IN (SELECT dst FROM edge)"""

ORACLE = {
    "bm25_topk": _bm25_sql("documents", "doc_id", "text", QUESTION, "LIMIT 5"),
    "bm25_repeated_terms": _bm25_sql("documents", "doc_id", "text", REPEATED, "LIMIT 20"),
    "bm25_pages": _bm25_sql("pages", "id", "body", QUESTION, ""),
    "fts_rank_filtered": "WITH " + _fts_sql(FTS, "(kind = 'chunk' OR type IN ('Concept', 'Product'))", 15) + " SELECT * FROM hits",
    "fts_tagged": "WITH " + _fts_sql(FTS, "contains(lower(tags), 'networking')", 15) + " SELECT * FROM hits",
    "seed_resolution": "WITH " + _fts_sql(FTS, "true", 15) + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY rank, row_id) AS ix FROM hits),
src AS (SELECT raw_path, min(id) AS page FROM sources WHERE raw_path <> '' GROUP BY raw_path)
SELECT CASE WHEN kind = 'page' THEN row_id ELSE page END AS id, CAST(min(ix) AS INTEGER) AS rank_ix FROM ranked LEFT JOIN src ON src.raw_path = split_part(row_id, '#', 1) GROUP BY 1 HAVING id IS NOT NULL ORDER BY rank_ix, id LIMIT 5""",
    "answer_contexts": f"WITH top AS (SELECT * FROM ({_bm25_sql('pages', 'id', 'body', QUESTION, 'LIMIT 5')})), " + _GRAPH + f""",
sd AS (SELECT {_C.format("id")} AS key, score FROM top),
al AS (SELECT key, true AS is_seed, score FROM sd UNION ALL SELECT dst, false, score FROM edge JOIN sd ON src = sd.key WHERE origin = 'frontmatter'),
g AS (SELECT key, bool_or(is_seed) AS is_seed, max(score) AS score FROM al GROUP BY key)
SELECT id, is_seed, score, substr(coalesce(body, ''), 1, 240) AS snippet FROM g JOIN page ON key = {_C.format("id")} ORDER BY is_seed DESC, score DESC, id LIMIT 8""",
    "graph_nodes": "WITH " + _GRAPH + " SELECT key, id, type, CAST(len(sources) AS INTEGER) AS n_sources, confidence, updated FROM node",
    "graph_edges": "WITH " + _GRAPH + " SELECT type, origin, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edge GROUP BY ALL",
    "ontology_conformance": "WITH " + _GRAPH + f""", {_SPECS},
ty AS (SELECT e.*, s.type IS NOT NULL AS known, dom, ran, a.type AS st, b.type AS dt FROM edge e LEFT JOIN spec s ON e.type = s.type LEFT JOIN node a ON e.src = a.key LEFT JOIN node b ON e.dst = b.key),
er AS (SELECT type, 'unknown_link_type' AS error FROM ty WHERE NOT known UNION ALL SELECT type, 'domain' FROM ty WHERE known AND st IS NOT NULL AND NOT list_contains(dom, st) UNION ALL SELECT type, 'range' FROM ty WHERE known AND dt IS NOT NULL AND NOT list_contains(ran, dt))
SELECT type, error, count(*) AS edges FROM er GROUP BY ALL""",
    "edges_resolved": "WITH " + _GRAPH + " SELECT src, type, count(*) AS edges FROM edge WHERE src IN (SELECT key FROM node) AND dst IN (SELECT key FROM node) GROUP BY ALL",
    "bfs_hops": "WITH " + _GRAPH + _BOTH + " SELECT key, CAST(hop AS INTEGER) AS hop FROM bfs",
    "expand_outgoing": "WITH " + _GRAPH + _OUT + " SELECT key FROM bfs",
    "typed_pattern": "WITH " + _GRAPH + """ SELECT DISTINCT src, dst FROM edge e JOIN node a ON src = a.key JOIN node b ON dst = b.key WHERE e.type = 'cites_evidence' AND a.type = 'Memo' AND b.type = 'Concept'
UNION ALL SELECT DISTINCT src, dst FROM edge e JOIN node a ON src = a.key JOIN node b ON dst = b.key WHERE e.type = 'justified_by' AND a.type = 'Decision' AND b.type = 'Memo'""",
    "coverage_by_type": "WITH " + _GRAPH + _BOTH + ", ot(type) AS (VALUES " + ", ".join(f"('{x}')" for x in ontology.OBJECT_TYPES) + "), ct AS (SELECT type, count(*) AS pages FROM bfs JOIN node USING (key) GROUP BY type) SELECT type, coalesce(pages, 0) AS pages, pages IS NULL AS is_gap FROM ot LEFT JOIN ct USING (type)",
    "provenance_chain": "WITH " + _GRAPH + _BOTH + f""", ss AS (SELECT {_C.format("id")} AS skey, arg_min(title, id) AS source_title FROM sources GROUP BY 1),
pc AS (SELECT key, hop, unnest(list_distinct(sources)) AS source FROM bfs JOIN node USING (key))
SELECT key, CAST(hop AS INTEGER) AS hop, source, source_title FROM pc LEFT JOIN ss ON skey = {_C.format("source")}""",
    "freshness_warnings": "WITH " + _GRAPH + f""", ss AS (SELECT {_C.format("id")} AS skey, max(substr(updated, 1, 10)) AS source_updated FROM sources WHERE {_ISO.format("updated")} IS NOT NULL GROUP BY 1),
pc AS (SELECT key, substr(updated, 1, 10) AS updated, unnest(list_distinct(sources)) AS source FROM node WHERE {_ISO.format("updated")} IS NOT NULL)
SELECT key, updated, source, source_updated FROM pc JOIN ss ON skey = {_C.format("source")} WHERE updated < source_updated QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_updated DESC, source) = 1""",
    "numeric_claims": "WITH " + _claims_sql() + " SELECT * FROM claim",
    "contradictions": "WITH " + _claims_sql("type IN ('Concept', 'Customer')") + """ SELECT kind, period, segment, count(DISTINCT (value, unit)) AS distinct_values, count(DISTINCT id) AS pages, count(*) AS claims, min(value) AS lowest, max(value) AS highest
FROM claim WHERE kind NOT IN ('percent', 'usd_billion', 'usd_million') OR (segment <> 'company_wide' AND period <> 'unspecified') GROUP BY ALL HAVING distinct_values > 1""",
    "metric_rollup": "WITH " + _claims_sql() + """ SELECT count(*) FILTER (WHERE kind = 'revenue') AS revenue_claims, min(value) FILTER (WHERE kind = 'revenue') AS min_revenue_usd_b, max(value) FILTER (WHERE kind = 'revenue') AS max_revenue_usd_b,
count(*) FILTER (WHERE kind = 'gross_margin') AS margin_claims, min(value) FILTER (WHERE kind = 'gross_margin') AS min_gross_margin_pct, max(value) FILTER (WHERE kind = 'gross_margin') AS max_gross_margin_pct FROM claim""",
    "numeric_completeness": _COMPLETE,
    "lint_report": _LINT,
    "lint_counts": f"SELECT rule, count(*) AS issues FROM (SELECT rule FROM ({_LINT}) UNION ALL SELECT 'extraction_completeness_gap' FROM ({_COMPLETE})) GROUP BY rule",
    "source_inventory": f"""
WITH s AS (SELECT DISTINCT id, raw_path FROM sources), r AS (SELECT {_C.format("source_id")} AS skey, count(DISTINCT {_C.format("page_id")}) AS pages FROM page_sources WHERE {_C.format("page_id")} <> '' GROUP BY 1),
c AS (SELECT raw_path, max(coalesce(len(chunks), 0)) AS chunks FROM parsed_documents GROUP BY 1)
SELECT id, coalesce(pages, 0) AS pages, CAST(coalesce(chunks, 0) AS BIGINT) AS chunks FROM s LEFT JOIN r ON {_C.format("id")} = skey LEFT JOIN c USING (raw_path)""",
    "kind_counts": "WITH " + _GRAPH + " SELECT 'node' AS kind, count(*) AS records FROM node UNION ALL SELECT 'edge', count(*) FROM edge UNION ALL SELECT 'provenance', CAST(sum(len(sources)) AS BIGINT) FROM node",
    "duplicate_ids": "WITH " + _SPELL + " SELECT key, count(*) AS spellings, CAST(sum(uses) AS BIGINT) AS uses FROM spelled GROUP BY key HAVING spellings > 1",
    "merge_winners": "WITH " + _SPELL + " SELECT * FROM winner",
    "rewritten_links": "WITH " + _SPELL + f" SELECT DISTINCT a.winner AS src, b.winner AS dst, type FROM links JOIN winner a ON a.key = {_C.format('from_id')} JOIN winner b ON b.key = {_C.format('to_id')}",
    "merged_sources": f"WITH x AS (SELECT DISTINCT {_C.format('id')} AS key, unnest({_JSON.format('source_ids')}) AS s FROM pages) SELECT key, string_agg(s, ',' ORDER BY s) AS sources FROM x GROUP BY key",
    "record_entities": f"""
WITH c AS (SELECT * FROM customer WHERE trim(c_name) <> '' AND trim(c_mktsegment) <> ''),
e AS (SELECT 'customer_' || {_C.format("c_name")} AS id, 'Customer' AS type, c_name AS name, c_custkey FROM c UNION ALL SELECT 'segment_' || {_C.format("c_mktsegment")}, 'Concept', c_mktsegment, c_custkey FROM c UNION ALL SELECT 'nation_' || c_nationkey, 'Concept', CAST(c_nationkey AS VARCHAR), c_custkey FROM c)
SELECT id, type, min(name) AS name, count(DISTINCT c_custkey) AS rows FROM e GROUP BY id, type""",
    "record_links": f"""
WITH c AS (SELECT * FROM customer WHERE trim(c_name) <> '' AND trim(c_mktsegment) <> '')
SELECT DISTINCT 'customer_' || {_C.format("c_name")} AS src, 'segment_' || {_C.format("c_mktsegment")} AS dst, 'operates_in' AS type FROM c
UNION SELECT DISTINCT 'nation_' || c_nationkey, 'customer_' || {_C.format("c_name")}, 'part_of' FROM c""",
    "record_content_hash": "WITH l AS (SELECT concat_ws(chr(1), 'n_name=' || coalesce(trim(n_name), ''), 'n_nationkey=' || coalesce(CAST(n_nationkey AS VARCHAR), ''), 'n_regionkey=' || coalesce(CAST(n_regionkey AS VARCHAR), '')) AS line FROM nation) SELECT sha256(string_agg(line, chr(2) ORDER BY line)) AS content_hash FROM l",
    "slugs": f"WITH p AS (SELECT id, min(title) AS t FROM pages GROUP BY id) SELECT id, substr(trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_'), 1, 60) AS letters, {_C.format('t')} AS ascii, replace(lower(t), ' ', '_') AS blank FROM p",
    "url_slugs": r"""
WITH u AS (SELECT DISTINCT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM crawl_pages)
SELECT url, substr(trim(regexp_replace(lower((CASE WHEN trim(path, '/') = '' THEN '/index' ELSE path END) || CASE WHEN query <> '' THEN '_' || substr(sha1(query), 1, 8) ELSE '' END), '[^a-z0-9]+', '_', 'g'), '_'), 1, 120) AS slug FROM u""",
    "html_text": f"""WITH {_HTMLS}, l AS (SELECT url, title, list_filter(list_transform(string_split(regexp_replace(coalesce(body, ''), '\\[\\[([a-zA-Z0-9_-]+)\\]\\]', '\\1', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ')), lambda x: x <> '') AS lines FROM htm)
SELECT url, CASE WHEN title IS NOT NULL THEN array_to_string(list_filter([trim(regexp_replace(title, '[ \\t]+', ' ', 'g'), ' ')], lambda x: x <> '') || ['See self, up & mail.'] || lines, chr(10)) END AS text FROM l""",
    "html_links": f"""WITH {_HTMLS}, a AS (SELECT url, ['https://kb.example/wiki/' || id, 'https://kb.example/wiki/up'] || list_transform(regexp_extract_all(coalesce(body, ''), '\\[\\[([a-zA-Z0-9_-]+)\\]\\]', 1), lambda x: 'https://kb.example/wiki/' || x) AS ls FROM htm WHERE title IS NOT NULL),
b AS (SELECT url, unnest(ls) AS link, generate_subscripts(ls, 1) AS i FROM a), c AS (SELECT url, link, min(i) AS i FROM b GROUP BY ALL)
SELECT url, CAST(row_number() OVER (PARTITION BY url ORDER BY i) - 1 AS INTEGER) AS n, link FROM c""",
    "crawl_frontier": f"""
WITH RECURSIVE row AS (SELECT {_NORM.format("regexp_replace(url, '#.*$', '')")} AS key, lower(host) AS host, {_NORM.format("regexp_replace(parent_url, '#.*$', '')")} AS parent, parent_url FROM crawl_pages WHERE url <> ''),
own AS (SELECT key, min(host) AS host FROM row GROUP BY key), st AS (SELECT DISTINCT key FROM row WHERE parent_url IS NULL),
same AS (SELECT * FROM own WHERE host IN (SELECT host FROM own SEMI JOIN st USING (key))),
walk AS (SELECT key, 0 AS hop FROM st UNION SELECT r.key, w.hop + 1 FROM walk w JOIN row r ON r.parent = w.key JOIN same s ON s.key = r.key WHERE w.hop < 3)
SELECT key, host, CAST(min(hop) AS INTEGER) AS hop FROM walk JOIN same USING (key) GROUP BY key, host""",
    "heading_sections": f"""
WITH {_PAGE}, l AS (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM page WHERE body IS NOT NULL),
h AS (SELECT *, regexp_matches(line, '^#{{1,6}}[ \\t]+\\S') AS is_h FROM l), g AS (SELECT *, sum(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS grp FROM h),
s AS (SELECT id, grp, coalesce(max(CASE WHEN is_h THEN length(regexp_extract(line, '^(#{{1,6}})', 1)) END), 0) AS level, coalesce(max(CASE WHEN is_h THEN trim(regexp_extract(line, '^#{{1,6}}[ \\t]+(.*)$', 1)) END), '') AS heading,
  regexp_replace(coalesce(string_agg(CASE WHEN NOT is_h THEN line END, chr(10) ORDER BY n), ''), '^\\s+|\\s+$', '', 'g') AS body FROM g GROUP BY id, grp),
k AS (SELECT * FROM s WHERE level > 0 OR body <> '')
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY grp) - 1 AS INTEGER) AS section, CAST(level AS INTEGER) AS level, heading, CAST(length(body) AS INTEGER) AS chars FROM k""",
    "paragraph_chunks": f"WITH {_PAGE}, p AS (SELECT id, list_filter(list_transform(regexp_split_to_array(body, '\\n\\s*\\n'), lambda x: trim(x)), lambda x: x <> '')[1:20] AS c FROM page WHERE body IS NOT NULL) SELECT id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk, substr(unnest(c), 1, 180) AS preview FROM p",
    "titles_summaries": f"WITH {_PAGE}, p AS (SELECT id, {_TITLE} AS title, {_LINES} AS s FROM page) SELECT id, title, CASE WHEN length(s) > 160 THEN rtrim(substr(s, 1, 157)) || '...' ELSE s END AS summary FROM p",
    "wikilinks": f"WITH {_PAGE}, p AS (SELECT id, regexp_extract_all(coalesce(body, ''), '\\[\\[([^\\]|#]+)(?:[|#][^\\]]*)?\\]\\]', 1) AS w FROM page) SELECT id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS n, trim(unnest(w)) AS target FROM p",
    "catalog": f"WITH {_PAGE} SELECT CAST(CASE type WHEN 'Customer' THEN 0 WHEN 'Product' THEN 1 WHEN 'Person' THEN 2 WHEN 'Concept' THEN 3 WHEN 'Source' THEN 4 ELSE 5 END AS INTEGER) AS ord, type, lower({_TITLE}) AS sort_title, id FROM page",
    "decisions_from_audit": f"WITH {_DEC} SELECT * FROM dec",
    "precedent_search": f"WITH {_DEC} SELECT id, ts, CAST(CASE WHEN entity IN ('entity_7', 'entity_9') THEN 5.0 ELSE 2.0 END AS DOUBLE) AS score FROM dec WHERE decision_class = 'review_flag' ORDER BY score DESC, ts DESC, id LIMIT 10",
    "precedent_for": f"WITH {_DEC}, x AS (SELECT id, ts, CAST(CASE WHEN entity = 'entity_3' THEN 3.0 ELSE 0.0 END + CASE WHEN action = 'flag_error' THEN 1.5 ELSE 0.0 END AS DOUBLE) AS score FROM dec WHERE id <> 'decision_flag_view_u7_202401010006291662') SELECT * FROM x WHERE score > 0 ORDER BY score DESC, ts DESC, id LIMIT 10",
    "replay_live_pages": f"""
WITH {_PAGE}, p AS (SELECT *, CASE WHEN regexp_extract(path, '([^/]+)/[^/]+$', 1) = '' THEN 'other' ELSE regexp_extract(path, '([^/]+)/[^/]+$', 1) END AS bucket, coalesce(CASE WHEN regexp_matches(updated, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(updated AS TIMESTAMPTZ) END, recorded_at) AS seen FROM page)
SELECT bucket, count(*) FILTER (WHERE coalesce(seen <= TIMESTAMPTZ '{CUTOFF}+00', true) AND (deleted_at IS NULL OR deleted_at > TIMESTAMPTZ '{CUTOFF}+00')) AS live, count(*) AS total FROM p GROUP BY bucket""",
    "replay_prior_decisions": f"WITH {_DEC} SELECT id, ts FROM dec WHERE ts <= '2024-01-10' ORDER BY ts DESC, id LIMIT 20",
    "review_queue_dedup": "SELECT DISTINCT 'user_' || user_id AS concept_id, event_type AS reason FROM events WHERE event_type IS NOT NULL",
    "review_queue_stream": "SELECT DISTINCT 'user_' || user_id AS concept_id, event_type AS reason FROM events WHERE event_type IS NOT NULL",
    "events_windowed": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL",
    "graph_export_nodes": "WITH " + _GRAPH + " SELECT key, '<node id=\"' || key || '\"><data key=\"type\">' || coalesce(type, '') || '</data></node>' AS xml, CAST(greatest(8, len(sources) * 2 + 8) AS INTEGER) AS value FROM node",
    "snapshot_roundtrip": "WITH " + _GRAPH + " SELECT 'node' AS kind, type, count(*) AS records FROM node GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edge GROUP BY type",
    "memo_summary": "WITH " + _GRAPH + _BOTH.replace("SELECT min(key) AS key FROM node GROUP BY type", "SELECT min(key) AS key FROM node WHERE type = 'Customer'") + ", " + _claims_sql(f"{_C.format('id')} IN (SELECT key FROM bfs)") + f""",
ss AS (SELECT {_C.format("id")} AS skey, max(substr(updated, 1, 10)) AS source_updated FROM sources WHERE {_ISO.format("updated")} IS NOT NULL GROUP BY 1),
pc AS (SELECT key, substr(updated, 1, 10) AS updated, unnest(list_distinct(sources)) AS source FROM node WHERE {_ISO.format("updated")} IS NOT NULL AND key IN (SELECT key FROM bfs)),
st AS (SELECT count(DISTINCT key) AS stale FROM pc JOIN ss ON skey = {_C.format("source")} WHERE updated < source_updated),
cg AS (SELECT kind, period, segment FROM claim JOIN page USING (id) WHERE page.type IN ('Concept', 'Customer') AND (kind NOT IN ('percent', 'usd_billion', 'usd_million') OR (segment <> 'company_wide' AND period <> 'unspecified')) GROUP BY ALL HAVING count(DISTINCT (value, unit)) > 1)
SELECT (SELECT count(*) FROM bfs) AS touched, (SELECT count(*) FROM (VALUES {", ".join(f"('{x}')" for x in ontology.OBJECT_TYPES)}) o(type) WHERE type NOT IN (SELECT type FROM node JOIN bfs USING (key))) AS gaps, (SELECT stale FROM st) AS stale,
  (SELECT count(*) FROM cg) AS contradictions, (SELECT min(value) FROM claim WHERE kind = 'revenue') AS min_revenue_usd_b, (SELECT max(value) FROM claim WHERE kind = 'revenue') AS max_revenue_usd_b""",
    "source_references": f"WITH {_PAGE}, r AS (SELECT id, unnest(list_distinct({_JSON.format('source_ids')})) AS source FROM page) SELECT {_C.format('source')} AS key, count(*) AS citations FROM r GROUP BY 1",
    "trace_kinds": "WITH c AS (SELECT raw_path, coalesce(provider, 'none') AS provider, unnest(chunks) AS c FROM parsed_documents) SELECT provider, c.type AS type, count(DISTINCT raw_path) AS documents, max(CAST(length(c.markdown) AS INTEGER)) AS longest FROM c GROUP BY ALL",
}
