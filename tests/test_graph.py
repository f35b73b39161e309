from datetime import datetime

from kgloom.operators import claims as C
from kgloom.operators import decisions as D
from kgloom.operators import graph as G
from kgloom.operators import ontology, quality, retrieval
from kgloom.operators.retrieval import Porter

T0 = datetime(2030, 1, 1)
PAGE = "id string, type string, title string, path string, source_ids string, confidence double, updated string, tags string, body string, recorded_at timestamp, deleted_at timestamp"


def pages(spark):
    def row(i, t, body="", src="[]", upd="2030-01-01"):
        return (i, t, i, f"wiki/x/{i}.md", src, None, upd, None, body, T0, None)

    rows = [
        row("acme", "Customer", "# Acme\nGross margin 75.0% in Q4 FY2026. revenue of $1.2 billion"),
        row("sla_t2", "Concept", "gross margin of 73.5% in q4 fy2026"),
        row("widget", "Product", None, '["src_a"]', "bad"),
        row("jane", "Person"),
        row("old", "Concept", upd="2020-01-01"),
        row("src_a", "Source", "[[acme]] [[Widget|W]] [[sla-t2#x]]"),
    ]
    return spark.createDataFrame(rows + rows[:2], PAGE)


def links(spark):
    rows = [(1, "Jane", "acme", "works_at"), (2, "acme", "sla t2", "has_sla"), (3, "jane", "sla_t2", "has_sla"), (4, "old", "nowhere", "mentions"), (5, "acme", "widget", "likes"), (6, None, "acme", "owns"), (1, "Jane", "acme", "works_at")]
    return spark.createDataFrame([(n, a, b, t, T0) for n, a, b, t in rows], "link_no bigint, from_id string, to_id string, type string, recorded_at timestamp")


def test_graph(spark):
    node, edge = G.nodes(pages(spark)), G.edges(links(spark), pages(spark))
    assert node.count() == 6 and edge.count() == 8
    errors = {(r.src, r.dst, r.error) for r in G.conformance(edge, node, ontology.link_types(spark)).collect()}
    assert errors == {("jane", "sla_t2", "domain"), ("acme", "widget", "unknown_link_type")}
    assert G.resolved(edge, node).count() == 7
    seed = node.where("key = 'jane'").select("key")
    own = edge.where("origin = 'frontmatter'")
    assert {(r.key, r.hop) for r in G.traverse(own, node, seed, 2).collect()} == {("jane", 0), ("acme", 1), ("sla_t2", 1), ("widget", 2)}
    assert {r.key for r in G.traverse(own, node, node.where("key = 'x'").select("key"), 2).collect()} == set()
    assert G.pattern(edge, node, "Person", "works_at").count() == 1
    lint = {(r.key, r.rule) for r in quality.lint(node, edge, "2030-02-01").collect()}
    assert {("old", "stale"), ("widget", "bad_date"), ("old", "broken_link"), ("jane", "orphan"), ("old", "orphan"), ("acme", "no_sources")} <= lint
    assert ("src_a", "orphan") not in lint


def test_claims(spark):
    claim = C.claims(pages(spark))
    assert {(r.id, r.kind, r.value) for r in claim.collect()} == {("acme", "gross_margin", 75.0), ("acme", "revenue", 1.2), ("sla_t2", "gross_margin", 73.5)}
    bad = C.contradictions(claim).collect()
    assert [(r.kind, r.period, r.distinct_values, r.pages) for r in bad] == [("gross_margin", "q4_fy2026", 2, 2)]
    assert C.rollup(claim.limit(0)).first().revenue_claims == 0


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, None), (4, ""), (1, "alpha beta beta")], "doc_id int, text string")
    got = [r.doc_id for r in retrieval.bm25(docs, "doc_id", "text", "beta alpha").collect()]
    assert got == [1, 2]
    assert retrieval.bm25(docs, "doc_id", "text", "?").count() == 0 and retrieval.bm25(docs.limit(0), "doc_id", "text", "beta").count() == 0
    once, twice = (retrieval.bm25(docs, "doc_id", "text", q).first().score for q in ("beta", "beta beta"))
    assert abs(twice - 2 * once) < 1e-5


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "controls": "control", "relays": "relai", "exported": "export", "hopping": "hop", "adjustable": "adjust", "probate": "probat", "sky": "sky"}
    assert {w: Porter.word(w) for w in pairs} == pairs


def test_decisions(spark):
    ev = spark.createDataFrame([(1, T0, 7, "error", 1.0, '{"k": 3}'), (1, T0, 7, "error", 1.0, '{"k": 3}'), (2, T0, 8, None, 1.0, None), (3, T0, 8, "view", 2.0, "bad")], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    dec = D.from_events(ev)
    assert dec.count() == 2
    assert [r.score for r in D.precedents(dec, ["entity_3"], cls="review_flag").collect()] == [5.0, 2.0]
    assert D.backfill(dec, dec.limit(1)).count() == 1
    assert D.review_queue(ev).count() == 2


def test_duplicates(spark):
    spelled = quality.spellings(pages(spark), links(spark))
    assert {(r.key, r.spellings) for r in quality.duplicates(spelled).collect()} == {("jane", 2), ("sla_t2", 2)}
    win = {r.key: r.winner for r in quality.winners(spelled, pages(spark)).collect()}
    assert win["jane"] == "jane" and win["sla_t2"] == "sla_t2"
    assert quality.rewrite(links(spark), quality.winners(spelled, pages(spark))).where("src = 'jane'").count() == 2
