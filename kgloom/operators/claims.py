"""Numeric claims in text: extraction with context, contradictions, rollups and completeness against sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_list, spans
from ..plans.materialize import broadcast_if_small, spread
from .orphans import canonical_id

PERCENT = r"\b\d{1,3}(?:\.\d+)?\s*%"
BILLION = r"(?i)\$\d+(?:\.\d+)?\s*(?:billion|B|bn)\b"
MILLION = r"(?i)\$\d+(?:\.\d+)?\s*(?:million|M|mn)\b"
NUMBER = r"\d+(?:\.\d+)?"

# Segments and the hints that tell them, in the order they are tried.
SEGMENTS = [
    ("data_center", ["data center", "datacenter"]),
    ("gaming", ["gaming"]),
    ("automotive", ["automotive"]),
    ("professional_visualization", ["professional visualization", "proviz"]),
    ("nvlink", ["nvlink"]),
    ("balance_sheet", ["balance sheet", "total assets", "current assets", "cash/cash equivalents", "marketable securities"]),
    ("shareholder_returns", ["share repurchase", "dividend", "shareholder"]),
    ("partnership", ["partnership", "collaboration", "investment in", "licensing"]),
]
# Periods and the forms that tell them, in the order they are tried.
PERIODS = [
    ("q4_fy2026", ["q4 fy2026", "q4 fiscal 2026"]),
    ("q1_fy2027", ["q1 fy2027", "q1 fiscal 2027"]),
    ("fy2025", ["fy2025", "fiscal 2025"]),
    ("fy2026", ["fy2026", "fiscal 2026", "fiscal year 2026"]),
]
KINDS = {"%": [("gross_margin", "gross margin"), ("operating_margin", "operating margin"), ("percent", "")], "USD_B": [("revenue", "revenue"), ("net_income", "net income"), ("operating_income", "operating income"), ("usd_billion", "")], "USD_M": [("usd_million", "")]}
GENERIC = ["percent", "usd_billion", "usd_million"]


def _first(context: Column, table: list[tuple[str, list[str]]], default: str) -> Column:
    out = F.lit(default)
    for name, hints in reversed(table):
        hit = context.contains(hints[0])
        for h in hints[1:]:
            hit = hit | context.contains(h)
        out = F.when(hit, name).otherwise(out)
    return out


def claims(pages: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """``key, start, kind, value, unit, period, segment``: figures in per cent and in billions and millions of dollars.

    The context that tells kind, period and segment is 80 characters before and 40 after the figure.  Keys given twice count once;
    null bodies have no claims.
    """
    every = F.array(
        F.struct(F.lit("%").alias("unit"), spans(body, PERCENT).alias("found")),
        F.struct(F.lit("USD_B").alias("unit"), spans(body, BILLION).alias("found")),
        F.struct(F.lit("USD_M").alias("unit"), spans(body, MILLION).alias("found")),
    )
    rows = spread(pages.select(key, body)).where(F.col(body).rlike("[%$]")).dropDuplicates([key]).select(key, F.col(body).alias("_b"), F.explode(every).alias("g")).select(key, "_b", "g.unit", F.explode("g.found").alias("m"))
    low = F.greatest(F.col("m.start") - 80, F.lit(0))
    context = F.lower(F.substring("_b", low + 1, F.col("m.start") + F.length("m.match") + 40 - low))
    rows = rows.select(key, "unit", F.col("m.start").alias("start"), F.regexp_extract("m.match", NUMBER, 0).cast("double").alias("value"), context.alias("context"))
    kind = F.lit(None).cast("string")
    for unit, table in KINDS.items():
        kind = F.when(F.col("unit") == unit, _first(F.col("context"), [(k, [h]) for k, h in table if h], table[-1][0])).otherwise(kind)
    return rows.select(key, "start", kind.alias("kind"), "value", "unit", _first(F.col("context"), PERIODS, "unspecified").alias("period"), _first(F.col("context"), SEGMENTS, "company_wide").alias("segment"))


def contradictions(claim: DataFrame, key: str = "id") -> DataFrame:
    """``kind, period, segment, values, pages, claims``: groups of claims with more than one value; generic kinds only where
    both period and segment are told.  Counts only, so a group of any size is one partial aggregate per task."""
    told = (F.col("segment") != "company_wide") & (F.col("period") != "unspecified")
    per_value = claim.where(~F.col("kind").isin(GENERIC) | told).groupBy("kind", "period", "segment", "value", "unit", key).agg(F.count("*").alias("n"))
    return (
        per_value.groupBy("kind", "period", "segment")
        .agg(F.count_distinct("value", "unit").alias("distinct_values"), F.count_distinct(key).alias("pages"), F.sum("n").alias("claims"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
        .where("distinct_values > 1")
    )


def contradicting(claim: DataFrame, key: str = "id") -> DataFrame:
    """``key``: the pages that take part in a contradiction."""
    group = ["kind", "period", "segment"]
    return claim.join(contradictions(claim, key).select(*group), group, "left_semi").select(F.col(key).alias("key")).distinct()


def rollup(claim: DataFrame) -> DataFrame:
    """Lowest and highest revenue (billions) and gross margin (per cent) and their numbers of claims; one row."""
    revenue, margin = F.when(F.col("kind") == "revenue", F.col("value")), F.when(F.col("kind") == "gross_margin", F.col("value"))
    return claim.agg(
        F.count(revenue).alias("revenue_claims"), F.min(revenue).alias("min_revenue_usd_b"), F.max(revenue).alias("max_revenue_usd_b"),
        F.count(margin).alias("margin_claims"), F.min(margin).alias("min_gross_margin_pct"), F.max(margin).alias("max_gross_margin_pct"),
    )


# The kinds of figures that the completeness of an extraction is told by; a figure may be of more than one kind.
FIGURES = {
    "usd_billion": r"(?i)\$\s*(\d{1,3}(?:[,.]\d{1,3})*(?:\.\d+)?)\s*(?:billion|B\b|bn\b)",
    "usd_million": r"(?i)\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(?:million|M\b|mn\b)",
    "usd_table": r"\$\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?)",
    "percent": r"(?<![A-Za-z0-9])(\d{1,3}(?:\.\d+)?)[ \t]*%",
}


def figures(parsed: DataFrame, most: int | None = None) -> DataFrame:
    """``raw_path, kind, line_no, raw, p``: the figures of each line of the parsed documents, the ``p``-th of their kind in the line;
    where ``most`` is given, so many a document and kind in order."""
    lines = parsed.where("markdown is not null").dropDuplicates(["raw_path"]).select("raw_path", F.posexplode(F.split("markdown", "\n")).alias("n", "line")).where(F.col("line").rlike("[%$]"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("line", F.lit(x), F.lit(1)).alias("found")) for k, x in FIGURES.items()])
    every = lines.select("raw_path", (F.col("n") + 1).alias("line_no"), F.explode(kinds).alias("g")).select("raw_path", "g.kind", "line_no", F.posexplode("g.found").alias("p", "raw"))
    if most is None:
        return every
    return every.withColumn("ix", F.row_number().over(Window.partitionBy("raw_path", "kind").orderBy("line_no", "p"))).where(F.col("ix") <= most).drop("ix")


def figure_forms(kind: Column, raw: Column) -> Column:
    """The forms of at least three characters in which a page may hold a figure: as written and without commas; percentages with
    one and two decimals and, if whole, without; billions in millions, cut, rounded and rounded to hundreds; millions and table
    figures in thousands of them with three, two and one decimals.  None for what is no number."""
    plain = F.replace(raw, F.lit(","), F.lit(""))
    value = plain.try_cast("decimal(30,9)")
    text = lambda x, d: F.bround(x, d).cast(f"decimal(38,{max(d, 0)})").cast("string")
    up, down = (value * 1000).cast("decimal(38,9)"), (value / 1000).cast("decimal(38,12)")
    scaled = (
        F.when(kind == "percent", F.array(text(value, 1), text(value, 2), F.when(value == F.floor(value), F.floor(value).cast("string"))))
        .when(kind == "usd_billion", F.array(F.floor(up).cast("string"), text(up, -2), text(up, 0)))
        .otherwise(F.array(text(down, 3), text(down, 2), text(down, 1)))
    )
    forms = F.when(value.isNotNull(), F.array_distinct(F.filter(F.concat(F.array(raw, plain), scaled), lambda x: x.isNotNull() & (F.length(x) >= 3))))
    return F.coalesce(forms, F.array().cast("array<string>"))


def completeness(parsed: DataFrame, sources: DataFrame, pages: DataFrame) -> DataFrame:
    """``raw_path, numerics, missing``: figures of each source document, dollars and percentages, that no page citing the source
    holds in any of their forms.

    Sources and pages meet by canonical source id; the numbers are looked up among the numbers of the citing pages, so no text
    is searched per number.  Sources that no page cites are left out.
    """
    src = sources.where("raw_path <> ''").select(canonical_id(F.col("id")).alias("skey"), "raw_path").distinct()
    cite = pages.dropDuplicates(["id"]).select(F.explode(F.array_distinct(F.transform(json_list("source_ids"), canonical_id))).alias("skey"), F.array_union(*[F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(x), F.lit(1)) for x in (r"(\d+(?:\.\d+)?)", r"(\d+(?:[,.]\d+)*)")]).alias("held"))
    cited = cite.join(broadcast_if_small(src), "skey")
    held = cited.select("raw_path", F.explode("held").alias("form")).distinct()
    wanted = figures(parsed).join(broadcast_if_small(cited.select("raw_path").distinct()), "raw_path", "left_semi")
    asked = wanted.select("raw_path", "kind", "line_no", "p", figure_forms(F.col("kind"), F.col("raw")).alias("forms")).where(F.size("forms") > 0)
    hit = asked.select("raw_path", "kind", "line_no", "p", F.explode("forms").alias("form")).join(held.withColumn("there", F.lit(True)), ["raw_path", "form"], "left").groupBy("raw_path", "kind", "line_no", "p").agg(F.max("there").alias("there"))
    return hit.groupBy("raw_path").agg(F.count("*").alias("numerics"), F.count_if(F.col("there").isNull()).alias("missing")).where("missing > 0")
