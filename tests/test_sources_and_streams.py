from datetime import datetime, timedelta

from kgloom.operators import decisions, graph
from kgloom.operators import orphans as O
from kgloom.sources import files, sinks
from kgloom.streaming import logs

T0 = datetime(2030, 1, 1)
EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark):
    return spark.createDataFrame([(i, T0 + timedelta(minutes=17 * i), i % 3, ["view", "error", None][i % 3 if i % 5 else 2], float(i), '{"k": 1}') for i in range(60)], EVENT)


def test_wiki_pages(spark, tmp_path):
    (tmp_path / "entities").mkdir()
    (tmp_path / "entities/acme.md").write_text('---\nid: "acme"\ntype: Customer\nsources: ["s1", "s2"]\nlinks: [{"to": "x", "type": "owns"}]\nconfidence: 0.9\nupdated: 2030-01-01\nregion: "EU"\n---\n# Acme Inc\nbody')
    (tmp_path / "plain.md").write_text("# Plain\ntext")
    (tmp_path / "index.md").write_text("skip")
    got = {r.id: r for r in files.wiki_pages(spark, str(tmp_path)).collect()}
    assert set(got) == {"acme", "plain"}
    a = got["acme"]
    assert (a.type, a.sources, a.links[0].to, a.confidence, a.title, a.extra) == ("Customer", ["s1", "s2"], "x", 0.9, "Acme Inc", {"region": '"EU"'})
    assert got["plain"].has_frontmatter is False and got["plain"].sources == []


def test_tables_and_logs(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿a,b\n 1 ,\n2,x\n", encoding="utf-8")
    assert [tuple(r) for r in files.record_table(spark, str(tmp_path / "r.csv")).collect()] == [("1", ""), ("2", "x")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "e.txt").write_text("hello")
    assert files.text_document(spark, str(tmp_path / "e.txt")).first().chunks[0].id == "liteparse-0"


def test_sinks(spark, tmp_path):
    node = spark.createDataFrame([("a", "T", ["s"]), ("b<", None, [])], "key string, type string, sources array<string>")
    edge = spark.createDataFrame([("a", "b<", "owns")], "src string, dst string, type string")
    sinks.snapshot({"node": node.select("key", "type"), "edge": edge}, str(tmp_path / "s"))
    assert {k: v.count() for k, v in files.snapshot(spark, str(tmp_path / "s")).items()} == {"node": 2, "edge": 1}
    sinks.graphml(node, edge, str(tmp_path / "g"))
    assert "b&lt;" in "".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect())
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert sinks.append_new(rows, str(tmp_path / "t"), ["k"]).count() == 2
    assert sinks.append_new(rows, str(tmp_path / "t"), ["k"]).count() == 0
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert graph.graphml_nodes(node).count() == 2


def test_streams_agree_with_batch(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    q = logs.review_queue(stream()).writeStream.format("memory").queryName("queue").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("queue").count() == decisions.review_queue(events(spark)).count()
    for _ in range(2):
        logs.decisions_to(stream(), str(tmp_path / "dec"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "dec")).count() == decisions.from_events(events(spark)).count()
    q = logs.windowed(stream()).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("hours").collect()} == {tuple(r) for r in logs.windowed(events(spark)).collect()}


def test_orphan_stream(spark, tmp_path):
    rows = spark.createDataFrame([("ref", 1, "a", T0), ("ref", 2, "b", T0), ("page", None, "A", T0 - timedelta(1))], "what string, no bigint, id string, at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    state = O.OrphanState(spark)

    def split(df):
        refs = O.references(df.where("what = 'ref'").withColumnRenamed("at", "recorded_at"), "links", "no", {"id": "pages"})
        return refs, O.parents(df.where("what = 'page'").selectExpr("id", "at AS recorded_at", "cast(null AS timestamp) AS deleted_at"), "pages")

    logs.track_orphans(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), state, split, str(tmp_path / "cp")).awaitTermination()
    assert [(r.row_no, r.kind) for r in state.current().collect()] == [(2, "missing")]
