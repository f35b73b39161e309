"""Near-duplicate records with small edits, by MinHash LSH forest.

Each text is the set of its distinct word shingles; records with equal sets are one class with one representative.  A forest of
``TREES`` prefix tries holds the representatives: a tree's label is a sequence of minhashes, and records under one prefix are
candidates, verified exactly on their shingles.  Records under one long prefix are under its shorter ones, too, so one depth is
enough: the longest at which a pair right at the threshold, the worst case, is found with the target probability.

Prefixes are 64-bit keys, sorted and joined with themselves by Spark, so that tries are never gathered in a task and a crowded
prefix is split like any skewed key; false matches of keys fall to the verification.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import broadcast_if_small, cut, release
from .arrow import map_arrow

TREES = 64
HASHES = 256  # minhashes of a record; a tree's label is a random sequence of them
DEPTHS = (8, 7, 6, 5, 4, 3, 2, 1)  # prefix lengths, the longest that reaches the target is taken
TARGET = 0.999  # recall of pairs at the threshold
CLASS_PART = 1000  # members of a class that meet a record in one task
WORD_CACHE = 500_000

_WORD = re.compile(r"[^\W_]+")
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, HASHES, dtype=np.uint64)
_PICK = np.stack([_RNG.permutation(HASHES)[: max(DEPTHS)] for _ in range(TREES)])
_SALT = _RNG.integers(0, 1 << 64, (TREES, max(DEPTHS)), dtype=np.uint64) | np.uint64(1)
_cache: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _cache.get(word)
    if h is None:
        if len(_cache) > WORD_CACHE:
            _cache.clear()
        h = _cache[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int, least_words: int) -> np.ndarray | None:
    """Sorted distinct hashes of the runs of ``size`` words; None for a text of fewer than ``least_words`` words."""
    words = _WORD.findall((text or "").lower())
    if len(words) < max(least_words, 1):
        return None
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    size = min(size, len(h))
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = _mix(out) + h[k : len(h) - size + 1 + k] * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(_mix(out))


def keys(sets: list[np.ndarray], depth: int) -> np.ndarray:
    """Keys of the prefixes of ``depth`` minhashes in each tree: an array of sets x trees."""
    out = np.empty((len(sets), TREES), np.uint64)
    for i, s in enumerate(sets):
        low = np.empty(HASHES, np.uint64)
        for j in range(0, HASHES, 64):
            part = s[:, None] * _A[None, j : j + 64] + _B[None, j : j + 64]
            low[j : j + 64] = (part ^ (part >> np.uint64(32))).min(axis=0)
        labels = _mix(low)[_PICK[:, :depth]]
        out[i] = _mix((labels * _SALT[:, :depth]).sum(axis=1, dtype=np.uint64))
    return out


def classes(rows: DataFrame, key: str, text: str, size: int, least_words: int) -> tuple[DataFrame, DataFrame]:
    """(members: ``key, rid``; representatives: ``rid, grams``).  Rows given twice count once."""
    src = rows.select(key, F.col(text).alias("_text")).where(F.col(key).isNotNull() & (F.length("_text") > 0))
    kind = src.schema[key].dataType.simpleString()

    def work(batch) -> dict:
        sets = [shingles(t, size, least_words) for t in batch.column("_text").to_pylist()]
        at = [i for i, s in enumerate(sets) if s is not None]
        return {
            key: batch.column(key).take(pa.array(at, pa.int64())),
            "h": [hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in at],
            "grams": pa.array([sets[i].view(np.int64) for i in at], pa.list_(pa.int64())),
        }

    sets = cut(map_arrow(src, f"`{key}` {kind}, h binary, grams array<bigint>", "_text", work), "sets")
    reps = cut(sets.groupBy("h").agg(F.min(key).alias("rep")).select("h", "rep", F.monotonically_increasing_id().alias("rid")), "reps")
    small = broadcast_if_small(reps)
    members = cut(sets.select(key, "h").join(small, "h").select(key, "rid").distinct(), "members")
    # one row of each class carries its shingles
    grams = cut(sets.join(broadcast_if_small(reps.select(F.col("h"), F.col("rep").alias(key), "rid")), ["h", key]).dropDuplicates(["rid"]).select("rid", "grams"), "grams")
    release(sets)
    return members, grams


def prefix(threshold: float) -> int:
    """The longest prefix under which a pair at ``threshold``, and so every more similar one, is found with ``TARGET``."""
    return next((d for d in DEPTHS if 1 - (1 - threshold**d) ** TREES >= TARGET), DEPTHS[-1])


def similar(reps: DataFrame, threshold: float) -> DataFrame:
    """``rid, grams`` to ``a, b, similarity``: pairs of different sets at or above the threshold, ``a < b``."""
    depth = prefix(threshold)

    def work(batch) -> dict:
        column = batch.column("grams")
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        sets = [values[a:b].view(np.uint64) for a, b in zip(offsets, offsets[1:])]
        k = keys(sets, depth)
        return {"key": k.view(np.int64).ravel(), "rid": np.repeat(batch.column("rid").to_numpy(zero_copy_only=False), TREES)}

    labels = cut(_map_lists(reps, "key bigint, rid bigint", work), "labels")
    pairs = cut(labels.select("key", F.col("rid").alias("a")).join(labels.select("key", F.col("rid").alias("b")), "key").where("a < b").select("a", "b").distinct(), "candidates")
    release(labels)
    involved = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    own = cut(reps.join(broadcast_if_small(cut(involved, "involved")), "rid", "left_semi"), "own")
    common = F.size(F.array_intersect("ga", "gb"))
    checked = (
        pairs.join(own.select(F.col("rid").alias("a"), F.col("grams").alias("ga")), "a")
        .join(own.select(F.col("rid").alias("b"), F.col("grams").alias("gb")), "b")
        .select("a", "b", (common / (F.size("ga") + F.size("gb") - common)).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    checked = cut(checked, "similar")
    release(own)
    return checked


def _map_lists(df: DataFrame, schema: str, work) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    target = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = pa.RecordBatch.from_struct_array(batch.slice(at, 1000).to_struct_array().take(pa.array(range(min(1000, batch.num_rows - at)))))
                out = work(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, kind)


def pairs(rows: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8, least_words: int = 1) -> DataFrame:
    """``id_a, id_b`` (smaller first) of different keys whose texts' shingle sets are at least ``threshold`` similar.

    Null and empty texts and texts of fewer than ``least_words`` words match nothing; a text shorter than a shingle is one
    shingle.  Keys given twice count once.  Every pair is listed, also within classes of equal shingles, whose texts may differ in
    case, punctuation or repeats; large classes are met in parts of ``CLASS_PART`` members.
    """
    members, reps = classes(rows, key, text, size, least_words)
    found = similar(reps, threshold)
    wide = members.groupBy("rid").agg(F.count("*").alias("n"))
    sized = members.join(wide, "rid").withColumn("parts", F.ceil(F.col("n") / CLASS_PART).cast("int"))
    sized = cut(sized.withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")), "sized")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    parts = sized.select(F.col("rid").alias("b"), "parts").distinct()
    across = (
        found.select("a", "b").join(parts, "b").select("a", "b", every)
        .join(sized.select(F.col("rid").alias("b"), "part", F.col(key).alias("y")), ["b", "part"])
        .join(sized.select(F.col("rid").alias("a"), F.col(key).alias("x")), "a")
        .select("x", "y")
    )
    own = sized.where("n > 1").select("rid", "part", F.col(key).alias("y"))
    within = sized.where("n > 1").select("rid", F.col(key).alias("x"), every).join(own, ["rid", "part"]).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups(rows: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8, least_words: int = 1) -> DataFrame:
    """``key, group_id``: one row per key with a text long enough; near-duplicates, direct or through others, share a group,
    named by its smallest key.  Keys without a partner are groups of their own."""
    members, reps = classes(rows, key, text, size, least_words)
    edges = similar(reps, threshold).select(F.col("a").alias("x"), F.col("b").alias("y"))
    label = cut(components(edges), "components")
    named = members.join(broadcast_if_small(label), "rid", "left").select(key, F.coalesce("root", "rid").alias("root"))
    names = named.groupBy("root").agg(F.min(key).alias("group_id"))
    return named.join(names, "root").select(key, "group_id")


def components(edges: DataFrame) -> DataFrame:
    """``x, y`` edges to ``rid, root``: the smallest node of each component, by alternating large and small stars.

    Each round links the neighbours of every node to the smallest among them, with plain grouped minima.
    """
    state = cut(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        same = state.count() == small.count() and not small.join(state, ["u", "v"], "left_anti").limit(1).count()
        release(large)
        release(state)
        state = small
        if same:
            break
    nodes = state.select(F.col("u").alias("rid"), F.col("v").alias("root"))
    return nodes.unionByName(state.select(F.col("v").alias("rid"), F.col("v").alias("root"))).groupBy("rid").agg(F.min("root").alias("root"))
