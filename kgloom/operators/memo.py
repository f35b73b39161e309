"""Intelligence memo of an entity: what a traversal touches, how well it is covered, where it is stale or disagrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import broadcast_if_small, cut
from . import claims as C
from . import graph as G
from . import ontology, quality
from .orphans import canonical_id


def build(pages: DataFrame, links: DataFrame, sources: DataFrame, seeds: DataFrame, hops: int = 2) -> dict[str, DataFrame]:
    """Frames ``touched, coverage, provenance, freshness, contradictions, metrics`` for the seeds (``key``).

    Traversal follows links in both directions; contradictions look at Concept and Customer pages, metrics at all touched pages.
    The touched set is written once and read by the five reports.
    """
    node, edge = cut(G.nodes(pages), "nodes"), G.edges(links)
    touched = cut(G.traverse(edge, node, seeds, hops), "touched")
    keys = broadcast_if_small(touched.select("key"))
    own = pages.withColumn("key", canonical_id(F.col("id"))).join(keys, "key", "left_semi")
    claim = cut(C.claims(own.select("key", "body"), key="key"), "claims")
    typed = claim.join(broadcast_if_small(node.where("type in ('Concept', 'Customer')").select("key")), "key", "left_semi")
    return {
        "touched": touched,
        "coverage": G.coverage(touched, node, ontology.object_types(pages.sparkSession)),
        "provenance": G.provenance(touched, node, sources),
        "freshness": quality.freshness(node.join(keys, "key", "left_semi"), sources),
        "contradictions": C.contradictions(typed, key="key"),
        "metrics": C.rollup(claim),
    }


def summary(memo: dict[str, DataFrame]) -> DataFrame:
    """One row: pages touched, object types without any, stale pages, contradicting groups and the range of revenue."""
    one = lambda name, expr, alias: memo[name].agg(expr.alias(alias)).withColumn("one", F.lit(1))
    out = one("touched", F.count("*"), "touched")
    for part in (one("coverage", F.count_if("is_gap"), "gaps"), one("freshness", F.count("*"), "stale"), one("contradictions", F.count("*"), "contradictions"), memo["metrics"].select("min_revenue_usd_b", "max_revenue_usd_b", F.lit(1).alias("one"))):
        out = out.join(F.broadcast(part), "one")  # one row each
    return out.drop("one")


def body(memo: dict[str, DataFrame], entity: str, examples: int = 3) -> str:
    """The memo as markdown; lists show the first examples, the counts are whole."""
    s = summary(memo).first()
    lines = [f"# Intelligence memo: {entity}", "", f"Touched pages: {s.touched}. Stale: {s.stale}. Contradictions: {s.contradictions}.", "", "## Coverage", ""]
    lines += [f"- {r.type}: {r.pages}" for r in memo["coverage"].orderBy("type").collect()]  # one row per object type
    lines += ["", "## Contradictions", ""]
    lines += [f"- {r.kind}, {r.period}, {r.segment}: {r.distinct_values} values, {r.lowest:g} to {r.highest:g}" for r in memo["contradictions"].orderBy(F.desc("pages"), "kind", "period", "segment").limit(examples).collect()]
    lines += ["", "## Revenue", "", f"{s.min_revenue_usd_b} to {s.max_revenue_usd_b} billion"]
    return "\n".join(lines)
