import re

from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.operators import records, web


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_tokens_and_spans(spark):
    s = "Revenue A x1 _b 3 margin 12.5% and 7% — Ünïc 5%"
    assert one(spark, s, T.tokens) == [w.lower() for w in re.findall(r"[a-zA-Z][a-zA-Z0-9_]+", s)]
    assert [(x.start, x.match) for x in one(spark, s, lambda c: T.spans(c, r"\d+(?:\.\d+)?%"))] == [(m.start(), m.group()) for m in re.finditer(r"\d+(?:\.\d+)?%", s)]
    assert one(spark, None, T.tokens) == [] and one(spark, "", lambda c: T.spans(c, "a")) == []


def test_slugs_and_titles(spark):
    assert one(spark, "Acme - Größe & Co.", T.slug_ascii) == "acme_gr_e_co"
    assert one(spark, "Acme - Größe & Co.", T.slug_letters) == "acme___größe___co"
    assert one(spark, "https://x.example/a/b?q=1#z", T.url_slug) .startswith("a_b_")
    assert one(spark, "https://x.example/", T.url_slug) == "index"
    assert one(spark, "intro\n# The Title \nx", lambda c: T.title(c, F.lit("k_1"))) == "The Title"
    assert one(spark, None, lambda c: T.title(c, F.lit("some_page"))) == "Some Page"
    assert one(spark, "# T\n" + "word " * 60, T.summary).endswith("...")
    assert one(spark, "# T\nOne. Two! Three?", T.first_sentences) == "One. Two!"
    assert one(spark, "[[a]] [[b|B]] [[c#x]] [[ d ]]", T.wikilinks) == ["a", "b", "c", "d"]


def test_sections(spark):
    got = [(x.level, x.heading, x.text) for x in one(spark, "pre\n# A\none\n\n## B \ntwo", T.sections)]
    assert got == [(0, "", "pre"), (1, "A", "one"), (2, "B", "two")]
    assert one(spark, None, T.sections) == []


def test_html(spark):
    html = "<nav><a href='/n'>n</a></nav><div class='x cookie'>c</div><p>Body &amp; <a href='a/b#t'>l</a></p><a href='//o.example/z'>o</a><a href='mailto:x'>m</a><a href='a/b'>l</a>"
    df = spark.createDataFrame([("https://s.example/d/e", html), ("https://s.example", None)], "url string, html string")
    assert [r.link for r in web.links(df).orderBy("n").collect()] == ["https://s.example/d/a/b", "https://o.example/z"]
    assert one(spark, html, web.text) == "Body & l\noml"


def test_records(spark):
    rows = spark.createDataFrame([("1", "Acme Ltd", "EU"), ("2", "", "EU"), ("3", "Beta", None)], "k string, name string, region string")
    manifest = {"target_type": "Customer", "identity": "c_{name|slug}", "name": "name", "required": ["name"], "citation": "f#row={k|raw}", "links": [{"to": "r_{region|lower}", "to_type": "Concept", "name": "region", "type": "part_of"}]}
    assert {(r.id, r.rows) for r in records.entities(rows, manifest).collect()} == {("c_acme_ltd", 1), ("c_beta", 1), ("r_eu", 1), ("r_row", 1)}
    assert {(r.src, r.dst) for r in records.links(rows, manifest).collect()} == {("c_acme_ltd", "r_eu"), ("c_beta", "r_row")}
    assert records.validate(manifest, ["Customer"], []) == ["unknown link type part_of"]
    a, b = rows.orderBy("k"), rows.orderBy(F.desc("k")).select("region", "k", "name")
    for h in (records.content_hash, records.exact_content_hash):
        assert h(a).first()[0] == h(b).first()[0] != h(rows.limit(2)).first()[0]
    assert records.content_hash(rows.limit(0)).count() == 1
