"""Health of the knowledge base: lint rules, duplicate ids and their merge, freshness, inventories and the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import day, json_list, summary, title
from ..plans.materialize import broadcast_if_small
from .ontology import LINK_TYPES, OBJECT_TYPES
from .orphans import canonical_id

STALE_DAYS = 180
# Types that head the catalog, in order; others follow alphabetically.
CATALOG_ORDER = ("Customer", "Product", "Person", "Concept", "Source")


def lint(node: DataFrame, edge: DataFrame, as_of: str, pages: DataFrame | None = None) -> DataFrame:
    """``key, rule, value``: stale or unreadable dates, pages without sources, unknown types, unknown link types, broken links,
    orphans and, where ``pages`` is given, pages without frontmatter.

    A page is stale when it was updated more than 180 days before ``as_of``.  Source pages and pages that an action wrote (a source
    that begins with ``action:``) are never orphans.  A page has no frontmatter if its id is blank, or its type and sources are null;
    it is named by its path.  Each case is one row, however often the page is delivered or the link repeated.
    """
    date = day("updated")
    age = F.datediff(F.lit(as_of).cast("date"), date)
    own = [
        node.where(date.isNull()).select("key", F.lit("bad_date").alias("rule"), F.col("updated").alias("value")),
        node.where(age > STALE_DAYS).select("key", F.lit("stale").alias("rule"), F.col("updated").alias("value")),
        node.where((F.size("sources") == 0) & (F.col("type") != "Source")).select("key", F.lit("no_sources").alias("rule"), F.lit("").alias("value")),
        node.where(~F.coalesce("type", F.lit("")).isin(*OBJECT_TYPES)).select("key", F.lit("unknown_type").alias("rule"), F.coalesce("type", F.lit("")).alias("value")),
    ]
    keys = broadcast_if_small(node.select("key"))
    broken = edge.select("src", F.col("dst").alias("key")).join(keys, "key", "left_anti").join(keys.withColumnRenamed("key", "src"), "src", "left_semi").select(F.col("src").alias("key"), F.lit("broken_link").alias("rule"), F.col("key").alias("value")).distinct()
    targets = edge.select(F.col("dst").alias("key")).distinct()
    written = F.exists("sources", lambda x: x.startswith("action:"))
    orphan = node.where((F.col("type") != "Source") & ~written).join(targets, "key", "left_anti").select("key", F.lit("orphan").alias("rule"), F.lit("").alias("value"))
    typed = edge.where(F.col("origin") == "frontmatter").select(F.col("src").alias("key"), F.lit("unknown_link_type").alias("rule"), F.coalesce("type", F.lit("")).alias("value"))
    unknown = typed.where(~F.col("value").isin(*LINK_TYPES)).distinct().join(keys, "key", "left_semi")
    found = [*own, broken, orphan, unknown]
    if pages is not None:
        bare = (F.coalesce(canonical_id(F.col("id")), F.lit("")) == "") | (F.col("type").isNull() & F.col("source_ids").isNull())
        found.append(pages.where(bare).select(F.coalesce("path", F.lit("")).alias("key"), F.lit("missing_frontmatter").alias("rule"), F.lit("").alias("value")).distinct())
    return reduce(DataFrame.unionByName, found)


def lint_counts(issues: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """``rule, issues``: how many issues of each rule, with the sources of incomplete extraction (rows of ``gaps``) as a rule."""
    out = issues.select("rule")
    if gaps is not None:
        out = out.unionByName(gaps.select(F.lit("extraction_completeness_gap").alias("rule")))
    return out.groupBy("rule").agg(F.count("*").alias("issues"))


def spellings(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``key, id, uses``: every spelling of an id, in pages and at the ends of links."""
    ends = links.dropDuplicates(["link_no"]).select(F.explode(F.array("from_id", "to_id")).alias("id"))
    return pages.select("id").distinct().unionByName(ends).where("id is not null").groupBy("id").agg(F.count("*").alias("uses")).select(canonical_id(F.col("id")).alias("key"), "id", "uses").where("key <> ''")


def duplicates(spelled: DataFrame) -> DataFrame:
    """``key, spellings, uses``: canonical ids that are spelled in more than one way."""
    return spelled.groupBy("key").agg(F.count("*").alias("spellings"), F.sum("uses").alias("uses")).where("spellings > 1")


def winners(spelled: DataFrame, pages: DataFrame) -> DataFrame:
    """``key, winner``: of the spellings of a canonical id the one a page has (longest body, then highest confidence), else the most
    used; ties go to the smallest."""
    page = pages.groupBy("id").agg(F.max(F.length(F.coalesce("body", F.lit("")))).alias("len"), F.max(F.coalesce("confidence", F.lit(0.5))).alias("conf"))
    # least first: pages before others, then by size, confidence, use and spelling
    order = F.struct(F.col("len").isNull(), -F.coalesce("len", F.lit(0)), -F.coalesce("conf", F.lit(0.0)), -F.col("uses"), F.col("id"))
    return spelled.join(page, "id", "left").groupBy("key").agg(F.min_by("id", order).alias("winner"))


def rewrite(links: DataFrame, winner: DataFrame) -> DataFrame:
    """``src, dst, type``: links with each end in its winning spelling, repeats removed; self-links stay."""
    a = broadcast_if_small(winner.select(F.col("key").alias("a"), F.col("winner").alias("src")))
    b = broadcast_if_small(winner.select(F.col("key").alias("b"), F.col("winner").alias("dst")))
    return links.select(canonical_id(F.col("from_id")).alias("a"), canonical_id(F.col("to_id")).alias("b"), "type").where("a <> '' and b <> ''").distinct().join(a, "a").join(b, "b").select("src", "dst", "type").distinct()


def freshness(node: DataFrame, sources: DataFrame) -> DataFrame:
    """``key, updated, source, source_updated``: pages updated before the newest of the sources they cite; dates compare as text and
    both must be readable."""
    src = sources.where(day("updated").isNotNull()).groupBy(canonical_id(F.col("id")).alias("skey")).agg(F.max(F.substring("updated", 1, 10)).alias("source_updated"))
    cited = node.where(day("updated").isNotNull()).select("key", F.substring("updated", 1, 10).alias("updated"), F.explode(F.array_distinct("sources")).alias("source")).withColumn("skey", canonical_id(F.col("source")))
    newest = Window.partitionBy("key").orderBy(F.desc("source_updated"), "source")
    return cited.join(broadcast_if_small(src), "skey").where("updated < source_updated").withColumn("n", F.row_number().over(newest)).where("n = 1").select("key", "updated", "source", "source_updated")


def inventory(sources: DataFrame, page_sources: DataFrame, parsed: DataFrame) -> DataFrame:
    """``id, pages, chunks``: distinct pages and chunks of each source; both sides are aggregated before they meet it."""
    own = sources.dropDuplicates(["id"]).select("id", "raw_path", canonical_id(F.col("id")).alias("skey"))
    refs = page_sources.select(canonical_id(F.col("source_id")).alias("skey"), canonical_id(F.col("page_id")).alias("page")).where("page <> ''").groupBy("skey").agg(F.count_distinct("page").alias("pages"))
    chunk = parsed.groupBy("raw_path").agg(F.max(F.coalesce(F.size("chunks"), F.lit(0))).alias("chunks"))
    return own.join(refs, "skey", "left").join(chunk, "raw_path", "left").select("id", F.coalesce("pages", F.lit(0)).alias("pages"), F.greatest(F.coalesce("chunks", F.lit(0)), F.lit(0)).cast("bigint").alias("chunks"))


def catalog(pages: DataFrame) -> DataFrame:
    """``ord, type, sort_title, id, entry``: the catalog's entries; sorted by the first four columns they are the catalog."""
    rank = F.lit(len(CATALOG_ORDER))
    for i, t in enumerate(CATALOG_ORDER):
        rank = F.when(F.col("type") == t, i).otherwise(rank)
    own = pages.dropDuplicates(["id"]).select("id", "type", rank.alias("ord"), title("body", "id").alias("t"), summary("body").alias("s"))
    return own.select("ord", "type", F.lower("t").alias("sort_title"), "id", F.concat(F.lit("- [["), "id", F.lit("]] — "), "t", F.lit(": "), "s").alias("entry"))


def union_sources(pages: DataFrame) -> DataFrame:
    """``key, sources``: the sorted union of the sources of all spellings of a page."""
    return pages.select(canonical_id(F.col("id")).alias("key"), F.explode(json_list("source_ids")).alias("s")).distinct().groupBy("key").agg(F.array_sort(F.collect_set("s")).alias("sources"))


def inbound(edge: DataFrame) -> DataFrame:
    """``key, inbound, from_pages``: links to each id and the distinct pages they come from."""
    return edge.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("inbound"), F.count_distinct("src").alias("from_pages"))


def merged_bodies(pages: DataFrame) -> DataFrame:
    """``key, bodies, body``: the different bodies of the spellings of an id, the longest first, joined by blank lines; of equally long
    ones the smaller first.  Null and empty bodies take no part."""
    own = pages.where(F.length("body") > 0).select(canonical_id(F.col("id")).alias("key"), "body").where("key <> ''").distinct()
    parts = F.array_sort(F.collect_list(F.struct((-F.length("body")).alias("n"), "body")))
    return own.groupBy("key").agg(F.count("*").alias("bodies"), F.array_join(F.transform(parts, lambda x: x["body"]), "\n\n").alias("body"))


def flagged(stale: DataFrame, contradicting: DataFrame) -> DataFrame:
    """``key``: pages that are stale or contradict others, once."""
    return stale.select("key").unionByName(contradicting.select("key")).distinct()
