from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kgloom.operators import decisions as D
from kgloom.operators import kb, quality, records, retrieval, web

T0 = datetime(2030, 1, 1)


def test_index_answers_as_the_scan_does(spark, tmp_path):
    texts = ["alpha beta gamma", "alpha alpha delta", None, "", "beta " * 5000, "x", "alpha beta gamma"]
    spark.createDataFrame([(i, x, "t", 7) for i, x in enumerate(texts)] + [(0, texts[0], "t", 7)], "id int, body string, term string, dl int").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    for question in ("which alpha beta", "beta beta gamma", "nothing here", "?"):
        want = {tuple(r) for r in retrieval.bm25(docs, "id", "body", question, None).collect()}
        assert {tuple(r) for r in kb.bm25(docs, "id", "body", question, None).collect()} == want
    path = kb.opened(docs, "id", "body")
    assert kb.opened(docs, "id", "body") == path  # the same files, the same index
    spark.createDataFrame([(99, "alpha", "t", 1)], "id int, body string, term string, dl int").write.mode("append").parquet(str(tmp_path / "t"))
    more = spark.read.parquet(str(tmp_path / "t"))
    assert kb.opened(more, "id", "body") != path
    assert 99 in {r.id for r in kb.bm25(more, "id", "body", "alpha", None).collect()}
    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none"))
    assert kb.bm25(spark.read.schema(docs.schema).parquet(str(tmp_path / "none")), "id", "body", "alpha").count() == 0


def test_links_of_inputs(spark):
    rows = [("a", {"target_entity": "acme-1", "actor": "jane", "name": "two words", "page_id": "acme-1", "other": "x"}, ["src_a", None, "src_a"], ["acme-1", "b"]), ("b", None, None, None), ("c", {"name": "--"}, [], None)]
    got = {tuple(r) for r in D.links_of_inputs(spark.createDataFrame(rows, "id string, inputs map<string,string>, cites array<string>, flagged array<string>")).collect()}
    assert got == {("a", "acme-1", "affects"), ("a", "jane", "approved_by"), ("a", "src_a", "justified_by"), ("a", "b", "affects")}


def test_precedents_by_links(spark):
    own = spark.createDataFrame([("d1", "2030", "flag_x", "review_flag", True, True), ("d2", "2031", "flag_x", "review_flag", None, False), ("d3", "2032", "run_x", "synthesis", True, True)], "id string, ts string, action string, decision_class string, approved boolean, ok boolean")
    links = spark.createDataFrame([("d1", "e1", "affects"), ("d1", "e2", "justified_by"), ("d1", "e1", "affects"), ("d2", "e1", "affects"), ("d3", "e1", "mentions")], "id string, dst string, type string")
    got = [(r.id, r.overlap, r.score) for r in D.precedents_by_links(own, links, ["e1", "e2"], cls="review_flag").collect()]
    assert got == [("d1", 2, 9.0), ("d2", 1, 5.0)]
    assert D.precedents_by_links(own.limit(0), links, ["e1"]).count() == 0
    classes = spark.createDataFrame([("create_a", True), ("trigger_b", None), ("flag_c", True), (None, None)], "a string, ok boolean").select(D.full_class(F.col("a"), F.col("ok")).alias("c"))
    assert [r.c for r in classes.collect()] == ["operational_write_approved", "operational_write_unapproved", "review_flag", "other"]


MANIFEST = {"target_type": "Customer", "identity": "c_{name}", "name": "name", "required": ["name"], "citation": "x.csv#{name|raw}"}


def test_second_ingest_writes_nothing(spark):
    rows = spark.createDataFrame([("Acme", " NY ", None), ("Acme", " NY ", None), (None, "x", "y"), ("  ", "x", "y")], "name string, city string, body string")
    none = spark.createDataFrame([], "id string, content_hash string")
    first = records.ingest(rows, MANIFEST, none)
    assert [(r.id, r.body) for r in first.collect()] == [("c_acme", "_Customer record imported from `x.csv#Acme`._\n\n- **city**: NY\n- **name**: Acme")]
    assert records.ingest(rows, MANIFEST, first).count() == 0
    assert records.ingest(rows.withColumn("city", F.lit("LA")), MANIFEST, first).count() == 1
    assert records.overview(rows, MANIFEST).first().asDict() == {"rows": 4, "complete": 2, "columns": "body,city,name"}


@pytest.mark.parametrize("href, want", [("../x?q=1#f", "https://h.example/a/x?q=1"), ("./y", "https://h.example/a/b/y"), ("../../../z/", "https://h.example/z/"), ("w", "https://h.example/a/b/w")])
def test_relative_links_are_resolved(spark, href, want):
    row = spark.createDataFrame([("https://h.example/a/b/c", f"<a href='{href}'>x</a>")], "url string, html string")
    assert [r.link for r in web.links(row).collect()] == [want]


def test_lint_rules_of_links_and_frontmatter(spark):
    node = spark.createDataFrame([("a", "a", "Concept", "p", ["action:x"], 0.5, "2030-01-01"), ("b", "b", "Concept", "p", ["s"], 0.5, "2030-01-01")], "key string, id string, type string, path string, sources array<string>, confidence double, updated string")
    edge = spark.createDataFrame([("a", "a", "invented", "frontmatter"), ("a", "a", None, "frontmatter"), ("b", "a", "mentions", "wikilink")], "src string, dst string, type string, origin string")
    pages = spark.createDataFrame([(" ", "Concept", "[]", "wiki/x.md"), ("q", None, None, "wiki/y.md"), ("a", "Concept", None, "wiki/a.md")], "id string, type string, source_ids string, path string")
    got = {(r.key, r.rule, r.value) for r in quality.lint(node, edge, "2030-01-02", pages).collect()}
    assert got == {("a", "unknown_link_type", "invented"), ("a", "unknown_link_type", ""), ("b", "orphan", ""), ("wiki/x.md", "missing_frontmatter", ""), ("wiki/y.md", "missing_frontmatter", "")}
    assert {r.rule: r.issues for r in quality.lint_counts(quality.lint(node, edge, "2030-01-02", pages)).collect()} == {"unknown_link_type": 2, "orphan": 1, "missing_frontmatter": 2}


def test_merged_bodies(spark):
    rows = spark.createDataFrame([("Acme", "long body"), ("acme-", "short"), ("acme", None), ("ACME", "short"), ("--", "x"), (None, "y")], "id string, body string")
    assert [tuple(r) for r in quality.merged_bodies(rows).collect()] == [("acme", 2, "long body\n\nshort")]


def test_cuts_are_released_and_swept(spark):
    import os

    from kgloom.plans.materialize import cut, release, sweep

    a, b = cut(spark.range(3).toDF("x"), "a"), cut(spark.range(4).toDF("x"), "b")
    assert (a.count(), b.count()) == (3, 4)
    release(a)
    assert not os.path.exists(a._kgloom_path.removeprefix("file://")) and sweep(spark) >= 1
    assert not os.path.exists(b._kgloom_path.removeprefix("file://")) and sweep(spark) == 0
