"""Parent–child links to full hierarchies, by heavy-path decomposition.

The steps, each a fixed number of shuffles on BIGINT node ids:

1. ``resolve_nodes``: one row per node with the id of its parent.
2. ``separate``: pointer doubling.  After round k a node knows its ancestor 2^k steps up and how many descendants it
   has within fewer than 2^k steps, so subtree sizes and the split into trees and endless chains come out after
   log2(height) rounds, whatever the fan-out.  Sums are pre-aggregated before they are shuffled.
3. ``chains``: each node joins the chain of its largest child; every node learns its chain's head and its position.
   A path to the root crosses at most log2(n) chains.
4. ``label``: doubling over the tree of chains gives for each chain the segments above it (so paths are concatenated
   segments) and the pre-order number of its head (so descendants are one interval of numbers per node).

No group is ever gathered in one task: siblings are numbered in two levels (hash buckets, then within a bucket).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import broadcast_if_small, cut, release

#: Siblings are numbered by bucket, then within the bucket, so a parent of a third of all rows is spread over as many tasks.
SIBLING_BUCKETS = 256


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, without port 443, fragment and one final slash; null stays null."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1))
    rest = F.substring(bare, F.length(head) + F.lit(1), F.length(bare))
    return F.regexp_replace(F.concat(F.regexp_replace(head, r":443$", ""), rest), r"/$", "")


def resolve_nodes(rows: DataFrame) -> DataFrame:
    """``url, parent_url, depth, fetched_at`` rows to one row per URL: ``id, url, depth, pid``.

    Of several rows of a URL the one with the latest ``fetched_at`` (as an instant) holds; an unreadable or null time
    counts as the earliest, ties go to the greatest spelling of the columns, so repeated rows give one result.  Rows with a
    null or blank url are not nodes.  ``pid`` is null for roots: parent null, blank or unknown.  Other columns are ignored.
    """
    key = normal_url(F.trim("url"))
    latest = (
        rows.where(F.trim("url") != "")
        .select(
            key.alias("key"),
            F.struct(
                F.try_to_timestamp("fetched_at").alias("at"),
                F.col("fetched_at").cast("string").alias("fetched_at"),
                F.col("url"),
                F.when(F.trim("parent_url") != "", normal_url(F.trim("parent_url"))).alias("parent"),
                F.col("depth").cast("bigint").alias("depth"),
            ).alias("row"),
        )
        .groupBy("key")
        .agg(F.max("row").alias("row"))
    )
    nodes = cut(latest.select(F.monotonically_increasing_id().alias("id"), "key", "row.url", "row.parent", "row.depth"), "nodes")
    parents = nodes.select(F.col("key").alias("parent"), F.col("id").alias("pid"))
    out = cut(nodes.join(broadcast_if_small(parents), "parent", "left").select("id", "url", "depth", "pid"), "resolved")
    release(nodes)
    return out


def separate(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, pid`` to (trees: ``id, pid, size``; endless: ``id, pid, anc``).

    ``size`` is the number of nodes of the subtree.  Doubling stops when no node is left whose chain reaches further
    (all are in trees), or when a round ends no chain: a chain that ended later would have an ancestor that ends in this
    round, so the rest never end.
    """
    state = cut(nodes.where("pid is not null").select("id", F.col("pid").alias("anc"), F.lit(1).cast("bigint").alias("size")), "jump")
    active, gains = state.count(), []
    while active:
        # only nodes whose chain goes on take part; a jump to any other node ends there
        gain = state.groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("gain"))
        up = broadcast_if_small(state.select(F.col("id").alias("anc"), F.col("anc").alias("next")))
        further = state.join(up, "anc").select("id", F.col("next").alias("anc"), "size")
        grown = further.join(broadcast_if_small(gain), "id", "left").select("id", "anc", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"), F.lit(True).alias("goes_on"))
        taken = cut(grown.unionByName(gain.select("id", F.lit(None).cast("bigint").alias("anc"), F.col("gain").alias("size"), F.lit(False).alias("goes_on"))), "jump")
        release(state)
        gains.append(taken.where("not goes_on").select("id", F.col("size").alias("gain")))
        state = taken.where("goes_on").drop("goes_on")
        left = state.count()
        if left == active:
            break
        active = left
    trees = nodes.select("id", "pid")
    if active:
        trees = trees.join(broadcast_if_small(state.select("id")), "id", "left_anti")
    size = F.lit(1).cast("bigint")
    if gains:
        total = reduce(DataFrame.unionByName, gains).groupBy("id").agg(F.sum("gain").alias("gain"))
        trees = trees.join(broadcast_if_small(cut(total, "gains")), "id", "left")
        size = F.coalesce("gain", F.lit(0)) + 1
    trees = cut(trees.select("id", "pid", size.alias("size")), "trees")
    return trees, state.join(broadcast_if_small(nodes.select("id", "pid")), "id").select("id", "pid", "anc")


def cycles(endless: DataFrame, names: DataFrame) -> DataFrame:
    """``id, pid, anc`` of the nodes whose chains never end, with ``id, url`` of all nodes, to ``id, cycle_url``.

    ``cycle_url`` is the smallest url on the cycle that the chain runs into.  The images of ever longer jumps shrink until
    only cycle nodes are left; the minimum then doubles its window along the cycle until it no longer changes.
    """
    state = cut(endless.select("id", "anc"), "endless")
    count = state.select("anc").distinct().count()
    if not count:
        return state.select("id", F.lit(None).cast("string").alias("cycle_url"))
    while True:
        up = state.select(F.col("id").alias("anc"), F.col("anc").alias("next"))
        new = cut(state.join(broadcast_if_small(up), "anc").select("id", F.col("next").alias("anc")), "endless")
        left = new.select("anc").distinct().count()
        release(state)
        state = new
        if left == count:
            break
        count = left
    on_cycle = state.select(F.col("anc").alias("id")).distinct()
    ring = cut(endless.join(broadcast_if_small(cut(on_cycle, "on_cycle")), "id").join(broadcast_if_small(names), "id").select("id", F.col("pid").alias("to"), F.col("url").alias("low")), "ring")
    while True:
        ahead = ring.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("low").alias("low2"))
        new = cut(ring.join(broadcast_if_small(ahead), "to").select("id", F.col("next").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")), "ring")
        moved = new.where("moved").count()
        release(ring)
        ring = new.drop("moved")
        if not moved:
            break
    return state.join(ring.select(F.col("id").alias("anc"), F.col("low").alias("cycle_url")), "anc").select("id", "cycle_url")


def chains(trees: DataFrame) -> DataFrame:
    """``id, pid, size`` to ``id, pid, size, head, pos, heavy``.

    ``head`` is the top node of the chain that the node is on, ``pos`` its place there from 0 and ``heavy`` the child
    that continues the chain (largest subtree, then smallest id; null at a leaf).
    """
    heavy = trees.where("pid is not null").groupBy(F.col("pid").alias("id")).agg(F.max(F.struct("size", (-F.col("id")).alias("n"))).alias("h"))
    linked = cut(trees.join(heavy.select("id", (-F.col("h.n")).alias("heavy"), F.col("h.size").alias("heavy_size")), "id", "left"), "heavy")
    # each node below the head of its chain jumps up; it has reached the head with a jump to a node that has, or is the head
    state = cut(linked.where("heavy is not null").select(F.col("heavy").alias("id"), F.col("id").alias("to"), F.lit(1).cast("bigint").alias("pos")), "chain")
    ended: list[DataFrame] = []
    while state.limit(1).count():
        known = reduce(DataFrame.unionByName, [x.withColumn("last", F.lit(True)) for x in ended], state.withColumn("last", F.lit(False)))
        ahead = broadcast_if_small(known.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("pos").alias("more"), "last"))
        step = state.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), F.coalesce("last", F.lit(True)).alias("done"))
        taken = cut(step, "chain")
        release(state)
        ended.append(taken.where("done").drop("done"))
        state = taken.where("not done").drop("done")
    if not ended:
        return cut(linked.select("*", F.col("id").alias("head"), F.lit(0).cast("bigint").alias("pos")), "chains")
    place = reduce(DataFrame.unionByName, ended)
    return cut(linked.join(broadcast_if_small(place), "id", "left").select(*linked.columns, F.coalesce("to", "id").alias("head"), F.coalesce("pos", F.lit(0)).alias("pos")), "chains")


def label(chained: DataFrame, numbered: bool = True) -> DataFrame:
    """``chains`` rows to one row per chain: ``head, segments, start``.

    ``segments`` are the ``(head, upto)`` of the chains above, from the root's; ``start`` is the pre-order number of the
    head within its tree.  Below each node comes first the subtree of its heavy child, then those of the other children.  Where
    ``numbered`` is off, ``start`` is not worked out.
    """
    light = chained.where("id = head and pid is not null").select("id", "pid", "size", F.pmod(F.xxhash64("id"), F.lit(SIBLING_BUCKETS)).alias("bucket"))
    per_bucket = light.groupBy("pid", "bucket").agg(F.sum("size").alias("total"))
    before = per_bucket.select("pid", "bucket", (F.sum("total").over(Window.partitionBy("pid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
    within = Window.partitionBy("pid", "bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    offset = (
        light.withColumn("inner", F.sum("size").over(within))
        .join(before, ["pid", "bucket"])
        .select("id", (F.coalesce("inner", F.lit(0)) + F.coalesce("base", F.lit(0))).alias("offset"))
    )
    parent = chained.select(F.col("id").alias("pid"), F.col("head").alias("up"), F.col("pos").alias("up_pos"), "heavy_size")
    segment = F.array(F.struct(F.col("up").alias("head"), F.col("up_pos").alias("upto")))
    none = F.array().cast("array<struct<head:bigint,upto:bigint>>")
    heads = chained.where("id = head").select("id", "pid")
    tops = (
        (heads.join(offset, "id", "left") if numbered else heads.withColumn("offset", F.lit(0).cast("bigint")))
        .join(broadcast_if_small(parent), "pid", "left")
        .select(
            F.col("id").alias("head"),
            "up",
            F.when(F.col("up").isNull(), none).otherwise(segment).alias("segments"),
            F.coalesce(F.col("up_pos") + 1 + F.col("heavy_size") + F.col("offset"), F.lit(0)).alias("start"),
        )
    )
    whole = cut(tops, "tops")
    done, state = [whole.where("up is null")], whole.where("up is not null")
    while state.limit(1).count():
        over = reduce(DataFrame.unionByName, [*done, state]).select(F.col("head").alias("up"), F.col("up").alias("next"), F.col("segments").alias("first"), F.col("start").alias("base"))
        taken = cut(state.join(broadcast_if_small(over), "up").select("head", F.col("next").alias("up"), F.concat("first", "segments").alias("segments"), (F.col("start") + F.col("base")).alias("start")), "tops")
        done.append(taken.where("up is null"))
        state = taken.where("up is not null")
    return reduce(DataFrame.unionByName, done).drop("up")


def hierarchy(rows: DataFrame, numbered: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``url, parent_url, depth, fetched_at`` rows to (nodes, members of trees, endless).

    nodes: ``id, url, depth, pid``.  members: ``id, head, pos, size, segments, root, real_depth, pre``; the descendants of
    a node are the members with the same ``root`` and ``pre`` in ``[pre, pre + size)``.  endless: ``id, cycle_url``.
    An empty table gives three empty frames.  Without ``numbered``, ``pre`` means nothing.
    """
    nodes = resolve_nodes(rows)
    trees, endless = separate(nodes)
    chained = chains(trees)
    labels = label(chained, numbered)
    members = chained.select("id", "head", "pos", "size").join(broadcast_if_small(labels), "head")
    members = members.select(
        "id",
        "head",
        "pos",
        "size",
        "segments",
        F.when(F.size("segments") > 0, F.col("segments")[0]["head"]).otherwise(F.col("head")).alias("root"),
        F.aggregate("segments", F.col("pos"), lambda acc, s: acc + s["upto"] + 1).alias("real_depth"),
        (F.col("start") + F.col("pos")).alias("pre"),
    )
    return nodes, members, cycles(endless, nodes.select("id", "url"))


def paths(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``id, path``: the urls from the root to each node, concatenated from the slices of its chains.

    A chain's urls are one array, as long as the chain; no longer than the longest path that comes out.
    """
    urls = members.select("id", "head", "pos").join(nodes.select("id", "url"), "id")
    arrays = urls.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("urls"))
    arrays = cut(arrays, "arrays")
    above = (
        members.where("id = head")
        .select(F.col("head").alias("chain"), F.posexplode("segments").alias("n", "s"))
        .select("chain", "n", F.col("s.head").alias("head"), F.col("s.upto").alias("upto"))
        .join(arrays, "head")
        .groupBy("chain")
        .agg(F.array_sort(F.collect_list(F.struct("n", F.slice("urls", F.lit(1), (F.col("upto") + 1).cast("int")).alias("part")))).alias("parts"))
        .select(F.col("chain").alias("head"), F.flatten(F.transform("parts", lambda p: p["part"])).alias("above"))
    )
    per_chain = arrays.join(above, "head", "left")
    # one row per chain is joined to its members, not the reverse: a chain's array is read once for each member
    return members.select("id", "head", "pos").join(per_chain, "head").select("id", F.concat(F.coalesce("above", F.array().cast("array<string>")), F.slice("urls", F.lit(1), (F.col("pos") + 1).cast("int"))).alias("path"))


def wrong_depths(rows: DataFrame) -> DataFrame:
    """``url, root_url, real_depth`` of the pages with a wrong depth, and of all pages whose chain never ends (-1)."""
    nodes, members, endless = hierarchy(rows, numbered=False)
    wrong = nodes.where("depth is not null").join(members.select("id", "root", "real_depth"), "id").where("depth <> real_depth")
    roots = nodes.select(F.col("id").alias("root"), F.col("url").alias("root_url"))
    a = wrong.join(broadcast_if_small(roots), "root").select("url", "root_url", "real_depth")
    b = endless.join(broadcast_if_small(nodes.select("id", "url")), "id").select("url", F.col("cycle_url").alias("root_url"), F.lit(-1).cast("bigint").alias("real_depth"))
    return a.unionByName(b)
