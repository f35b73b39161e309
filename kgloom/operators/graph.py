"""Typed graph over pages: compile, conformance, traversal, patterns, coverage and provenance.

Ids are compared in canonical form.  Node tables have one row per id, so joins of edges with nodes are many-to-one; a hub is a hot key
on the edges' side only.  Traversals join the frontier with the edges level by level and cut the lineage per level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_list, wikilinks
from ..plans.materialize import broadcast_if_small, cut, release

from .orphans import canonical_id


def nodes(pages: DataFrame) -> DataFrame:
    """``key, id, type, path, sources, confidence, updated``: one row per canonical id; defaults for null confidence (0.5), updated
    (empty) and sources (none).  Of several spellings of an id the smallest holds."""
    row = F.struct("id", "type", "path", json_list("source_ids").alias("sources"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("updated", F.lit("")).alias("updated"))
    return pages.where(canonical_id(F.col("id")) != "").groupBy(canonical_id(F.col("id")).alias("key")).agg(F.min_by(row, "id").alias("r")).select("key", "r.*")


def edges(links: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``src, dst, type, origin``: a bag of edges, repeated deliveries of a row removed.  ``origin`` is ``frontmatter``, or
    ``wikilink`` for the links in the bodies of Source pages.  Edges with a blank end are dropped."""
    own = links.dropDuplicates(["link_no"]).select(canonical_id(F.col("from_id")).alias("src"), canonical_id(F.col("to_id")).alias("dst"), "type", F.lit("frontmatter").alias("origin"))
    if pages is not None:
        source = pages.where("type = 'Source'").select("id", wikilinks("body").alias("w")).dropDuplicates(["id"])
        own = own.unionByName(source.select(canonical_id(F.col("id")).alias("src"), F.explode("w").alias("d")).select("src", canonical_id(F.col("d")).alias("dst"), F.lit("mentions").alias("type"), F.lit("wikilink").alias("origin")))
    return own.where("src <> '' and dst <> ''")


def conformance(edge: DataFrame, node: DataFrame, specs: DataFrame) -> DataFrame:
    """``src, dst, type, error``: unknown link types, and ends outside a type's domain or range (two errors are two rows).

    Unknown ends are not checked; an edge of an unknown type has that error only.
    """
    known = node.select("key", F.col("type").alias("t"))
    typed = (
        edge.join(F.broadcast(specs.withColumn("known", F.lit(True))), "type", "left")
        .join(broadcast_if_small(known.withColumnsRenamed({"key": "src", "t": "src_type"})), "src", "left")
        .join(broadcast_if_small(known.withColumnsRenamed({"key": "dst", "t": "dst_type"})), "dst", "left")
    )
    wrong = lambda spec, kind: (F.size(spec) > 0) & F.col(kind).isNotNull() & ~F.array_contains(F.col(spec), F.col(kind))
    errors = F.filter(
        F.array(
            F.when(F.col("known").isNull(), "unknown_link_type"),
            F.when(F.col("known") & wrong("domain", "src_type"), "domain"),
            F.when(F.col("known") & wrong("range", "dst_type"), "range"),
        ),
        lambda x: x.isNotNull(),
    )
    return typed.select("src", "dst", "type", F.explode(errors).alias("error"))


def resolved(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    keys = node.select("key")
    return edge.join(broadcast_if_small(keys.withColumnRenamed("key", "src")), "src", "left_semi").join(broadcast_if_small(keys.withColumnRenamed("key", "dst")), "dst", "left_semi").select(*edge.columns)


def traverse(edge: DataFrame, node: DataFrame, seeds: DataFrame, hops: int, both: bool = True) -> DataFrame:
    """``key, hop``: nodes within ``hops`` of the seeds (``key``), with the smallest distance; only existing nodes are entered.

    Each level joins the frontier, not what was visited before, and drops known nodes by an anti join.
    """
    step = edge.select("src", "dst")
    if both:
        step = step.unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # the edges and the nodes' keys are worked out once, not on every level
    step, keys = cut(step, "steps"), cut(node.select("key"), "keys")
    seen = cut(seeds.select("key").distinct().join(keys, "key", "left_semi").withColumn("hop", F.lit(0)), "seen")
    front = seen
    for hop in range(1, hops + 1):
        reached = step.join(broadcast_if_small(front.select(F.col("key").alias("src"))), "src", "left_semi").select(F.col("dst").alias("key")).distinct()
        front = cut(reached.join(broadcast_if_small(seen.select("key")), "key", "left_anti").join(broadcast_if_small(keys), "key", "left_semi").withColumn("hop", F.lit(hop)), "front")
        seen = seen.unionByName(front)
        if not front.limit(1).count():
            break
    release(step)
    release(keys)
    return seen


def pattern(edge: DataFrame, node: DataFrame, src_type: str, link: str, dst_type: str | None = None) -> DataFrame:
    """``src, dst``: pairs of nodes of the given types joined by a link of the given type, with repeats removed."""
    a = node.where(F.col("type") == src_type).select(F.col("key").alias("src"))
    b = (node if dst_type is None else node.where(F.col("type") == dst_type)).select(F.col("key").alias("dst"))
    return edge.where(F.col("type") == link).select("src", "dst").join(broadcast_if_small(a), "src", "left_semi").join(broadcast_if_small(b), "dst", "left_semi").distinct()


def coverage(touched: DataFrame, node: DataFrame, types: DataFrame) -> DataFrame:
    """``type, pages, is_gap``: touched nodes per object type, types without any included."""
    counts = touched.join(node.select("key", "type"), "key").groupBy("type").agg(F.count("*").alias("pages"))
    return types.join(counts, "type", "left").select("type", F.coalesce("pages", F.lit(0)).alias("pages"), F.col("pages").isNull().alias("is_gap"))


def provenance(touched: DataFrame, node: DataFrame, sources: DataFrame) -> DataFrame:
    """``key, hop, source, source_title``: each touched node's sources; a source is found by its canonical id, the title is null if
    it is unknown.  Of several sources of one canonical id the smallest id holds."""
    src = sources.groupBy(canonical_id(F.col("id")).alias("skey")).agg(F.min_by("title", "id").alias("source_title"))
    cited = touched.join(node.select("key", F.explode(F.array_distinct("sources")).alias("source")), "key").withColumn("skey", canonical_id(F.col("source")))
    return cited.join(broadcast_if_small(src), "skey", "left").select("key", "hop", "source", "source_title")


def graphml_nodes(node: DataFrame) -> DataFrame:
    """``key, xml, value``: one GraphML element per node and the size it is drawn with."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    xml = F.concat(F.lit('<node id="'), esc(F.col("key")), F.lit('"><data key="type">'), esc(F.coalesce("type", F.lit(""))), F.lit("</data></node>"))
    return node.select("key", xml.alias("xml"), F.greatest(F.lit(8), F.size("sources") * 2 + 8).alias("value"))


def frontier(pages: DataFrame, seeds: DataFrame, depth: int, budget: int | None = None) -> DataFrame:
    """``key, host, hop``: the pages a crawl from the seeds visits: breadth first along the found-on links, on the seeds' hosts,
    each once, at most ``budget`` in order of hop and url."""
    from .hierarchy import normal_url

    rows = pages.where("url <> ''").select(normal_url(F.col("url")).alias("key"), F.lower("host").alias("host"), normal_url(F.col("parent_url")).alias("parent"))
    own = rows.groupBy("key").agg(F.min("host").alias("host"))
    step = rows.where("parent is not null").select(F.col("parent").alias("src"), F.col("key").alias("dst")).distinct()
    start = seeds.select(normal_url(F.col("url")).alias("key")).distinct()
    hosts = own.join(start, "key", "left_semi").select("host").distinct()
    same = own.join(broadcast_if_small(cut(hosts, "hosts")), "host", "left_semi")
    seen = traverse(step, same, start, depth, both=False)
    out = seen.join(same, "key").select("key", "host", "hop")
    return out if budget is None else out.orderBy("hop", "key").limit(budget)
