import pytest
from pyspark.sql import functions as F

from kgloom.operators import claims, web


@pytest.mark.parametrize(
    "kind, raw, want",
    [
        ("usd_billion", "6.794", {"6.794", "6794", "6800"}),
        ("usd_billion", "1,250.5", {"1,250.5", "1250.5", "1250500"}),
        ("usd_million", "6,794", {"6,794", "6794", "6.794", "6.79", "6.8"}),
        ("usd_table", "12,345", {"12,345", "12345", "12.345", "12.34", "12.3"}),  # 12.345 halves to even
        ("percent", "75.0", {"75.0", "75.00"}),
        ("usd_billion", "1.2.3", set()),
    ],
)
def test_forms(spark, kind, raw, want):
    row = spark.createDataFrame([(kind, raw)], "kind string, raw string").select(claims.figure_forms(F.col("kind"), F.col("raw")).alias("f")).first()
    assert set(row.f) == want


def completeness(spark, markdown, body):
    parsed = spark.createDataFrame([("raw/a.pdf", markdown)], "raw_path string, markdown string")
    sources = spark.createDataFrame([("a", "raw/a.pdf")], "id string, raw_path string")
    pages = spark.createDataFrame([("p", '["a"]', body)], "id string, source_ids string, body string")
    return [tuple(r) for r in claims.completeness(parsed, sources, pages).collect()]


def test_dollar_figures_are_checked(spark):
    text = "Revenue $6.794 billion, cost $ 1,250 million\n| cash | $12,345 |\nmargin 75.5%"
    # the comma group of the million is a table figure, too
    assert completeness(spark, text, "nothing") == [("raw/a.pdf", 5, 5)]
    assert completeness(spark, text, "made 6794 million at 1.25, 12,345 in cash") == [("raw/a.pdf", 5, 1)]
    assert completeness(spark, text, "made 6.794, cost 1250, 12.3 in cash, 75.50 in all") == []


def test_long_documents_are_whole(spark):
    text = "\n".join(f"{10 + i % 80}.{i % 10}% of ${100 + i}.5 million" for i in range(260))
    assert completeness(spark, text, "") == [("raw/a.pdf", 520, 520)]
    body = "\n\n".join(f"paragraph {i}" for i in range(30))
    rows = web.paragraph_chunks(spark.createDataFrame([("p", body)], "id string, body string"), "id", "body").collect()
    assert sorted((r.chunk, r.preview) for r in rows) == [(i, f"paragraph {i}") for i in range(30)]
