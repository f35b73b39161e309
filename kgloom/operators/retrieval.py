"""Ranked retrieval: Okapi BM25, fielded full-text rank, seeds, expansion and answer contexts.

A query has a handful of terms, so a document's term frequencies are counted in place from its token array: one scan
leaves a small table of lengths and hits, from which the corpus statistics (a single-row aggregate), the scores and a top-k are
taken; nothing is exploded or shuffled by term.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN, json_list, lower_ascii, tokens
from ..plans.materialize import broadcast_if_small, cut, spread
from .orphans import canonical_id

K1, B = 1.5, 0.75
FTS_K1, FTS_B = 1.2, 0.75


def query_terms(question: str) -> Counter[str]:
    """Terms of a question with their multiplicity: a repeated term counts repeatedly."""
    return Counter(t.lower() for t in re.findall(TOKEN, question))


def _tf(terms: list[str]) -> list[Column]:
    count = lambda w: F.size(F.filter("hits", lambda t: t == w))
    return [count(w).alias(f"tf{i}") for i, w in enumerate(terms)]


def _hits(words: list[str]) -> list[Column]:
    """Length of a document and its tokens that are query terms; only these few leave the scan."""
    return [F.size("tokens").alias("dl"), F.filter("tokens", lambda t: t.isin(words)).alias("hits")]


def bm25(docs: DataFrame, key: str, text: str, question: str, top_k: int | None = 5) -> DataFrame:
    """``key, score``: the ``top_k`` documents with a positive score, ties by key; all of them with None.

    Keys given twice count once.  Null and empty texts have no terms but count as documents.  A question without terms and an
    empty table give no rows.
    """
    terms = query_terms(question)
    words = list(terms)
    small = spread(docs.select(key, text)).select(F.col(key), tokens(text).alias("tokens")).select(key, *_hits(words)).dropDuplicates([key])
    own = cut(small, "bm25").select(key, "dl", *_tf(words))
    stats = own.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()
    if not words or not stats["n"] or not stats["avg"]:
        return own.select(key, F.lit(0.0).alias("score")).where("false")
    parts = []
    for i, w in enumerate(words):
        idf = math.log(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        tf = F.col(f"tf{i}")
        parts.append(F.lit(terms[w] * idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.greatest("dl", F.lit(1)) / F.lit(stats["avg"]))))
    scored = own.select(key, F.round(reduce(lambda a, b: a + b, parts), 6).alias("score")).where("score > 0")
    return scored if top_k is None else scored.orderBy(F.desc("score"), key).limit(top_k)


def fts_documents(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows of the full-text index: pages, and the chunks of parsed documents; of a repeated chunk id the last holds."""
    page = pages.dropDuplicates(["id"]).select(
        F.lit("page").alias("kind"), F.col("id").alias("row_id"), "type", F.get(json_list("source_ids"), F.lit(0)).alias("source_id"), "path", "title", F.coalesce("tags", F.lit("")).alias("tags"), F.col("body").alias("content")
    )
    chunk = (
        parsed.dropDuplicates(["raw_path"])
        .select("raw_path", F.posexplode("chunks").alias("n", "c"))
        .groupBy("raw_path", F.coalesce("c.id", F.concat(F.lit("#"), F.col("n"))).alias("cid"))
        .agg(F.max_by("c", "n").alias("c"))
        .select(F.lit("chunk").alias("kind"), F.concat("raw_path", F.lit("#"), "cid").alias("row_id"), F.col("c.type").alias("type"), F.col("raw_path").alias("source_id"), F.col("raw_path").alias("path"), F.lit("").alias("title"), F.lit("").alias("tags"), F.col("c.markdown").alias("content"))
    )
    return page.unionByName(chunk)


def fts_rank(rows: DataFrame, query: str, *, types: list[str] | None = None, tags: list[str] | None = None, source_ids: list[str] | None = None, limit: int = 10, stem=None) -> DataFrame:
    """``row_id, kind, rank``: rank is minus the score, smaller is better; ties by row id.

    All columns are searched; terms are joined by OR; filters on types never remove chunks and tags match as substrings,
    whatever their case.  The score floors the inverse document frequency at 1e-6.  ``stem`` maps an array of tokens.
    """
    words = sorted({t.lower() for t in re.findall(r"[A-Za-z0-9]+", query)})
    found = F.regexp_extract_all(lower_ascii(F.concat_ws(" ", "kind", "row_id", "type", "source_id", "path", "title", "tags", "content")), F.lit("([a-z0-9]+)"), F.lit(1))
    if stem is not None:
        words, found = sorted({stem.word(w) for w in words}), stem(found)
    small = rows.withColumn("tokens", found).select("row_id", "kind", "type", "source_id", "tags", *_hits(words))
    own = cut(small, "fts").select("row_id", "kind", "type", "source_id", "tags", "dl", *_tf(words))
    stats = own.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()
    if not words or not stats["n"] or not stats["avg"]:
        return own.select("row_id", "kind", F.lit(0.0).alias("rank")).where("false")
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = math.log(max((stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5), 1e-300))
        tf = F.col(f"tf{i}")
        score = score + F.lit(max(idf, 1e-6)) * tf * (FTS_K1 + 1) / (tf + FTS_K1 * (1 - FTS_B + FTS_B * F.col("dl") / F.lit(stats["avg"])))
    hit = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(words))])
    if source_ids:
        hit = hit & F.col("source_id").isin(source_ids)
    if types:
        hit = hit & ((F.col("kind") == "chunk") | F.col("type").isin(types))
    for t in tags or []:
        hit = hit & F.lower("tags").contains(t.lower())
    return own.where(hit).select("row_id", "kind", F.round(-score, 6).alias("rank")).orderBy("rank", "row_id").limit(limit)


class Porter:
    """Porter's suffix stripping as a vectorised function over arrays of tokens."""

    VOWELS = "aeiou"

    @classmethod
    def _cons(cls, w: str, i: int) -> bool:
        c = w[i]
        if c in cls.VOWELS:
            return False
        return not (c == "y" and i > 0 and cls._cons(w, i - 1))

    @classmethod
    def measure(cls, w: str) -> int:
        kinds = "".join("c" if cls._cons(w, i) else "v" for i in range(len(w)))
        return sum(kinds[i] == "v" and kinds[i + 1] == "c" for i in range(len(kinds) - 1))

    @classmethod
    def _vowel(cls, w: str) -> bool:
        return any(not cls._cons(w, i) for i in range(len(w)))

    @classmethod
    def _double(cls, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and cls._cons(w, len(w) - 1)

    @classmethod
    def _cvc(cls, w: str) -> bool:
        n = len(w)
        return n > 2 and cls._cons(w, n - 1) and not cls._cons(w, n - 2) and cls._cons(w, n - 3) and w[-1] not in "wxy"

    # Suffix and replacement of steps 2, 3 and 4 of the published algorithm.
    STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
    STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

    @classmethod
    def word(cls, w: str) -> str:
        if len(w) < 3 or not w.isascii() or not w.isalpha():
            return w
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if cls.measure(w[:-3]) > 0 else w
        else:
            for end in ("ed", "ing"):
                if w.endswith(end) and cls._vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif cls._double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif cls.measure(w) == 1 and cls._cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and cls._vowel(w[:-1]):
            w = w[:-1] + "i"
        for table in (cls.STEP2, cls.STEP3):
            for end, new in sorted(table, key=lambda x: -len(x[0])):
                if w.endswith(end):
                    if cls.measure(w[: -len(end)]) > 0:
                        w = w[: -len(end)] + new
                    break
        for end in sorted(cls.STEP4, key=len, reverse=True):
            if w.endswith(end):
                stem = w[: -len(end)]
                if cls.measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                    w = stem
                break
        if w.endswith("e"):
            m = cls.measure(w[:-1])
            if m > 1 or (m == 1 and not cls._cvc(w[:-1])):
                w = w[:-1]
        return w[:-1] if w.endswith("ll") and cls.measure(w) > 1 else w

    def __call__(self, column: Column) -> Column:
        word = self.word

        @F.pandas_udf("array<string>")
        def stems(lists: pd.Series) -> pd.Series:
            known: dict[str, str] = {}
            return lists.map(lambda ws: [known[w] if w in known else known.setdefault(w, word(w)) for w in ws] if ws is not None else None)

        return stems(column)


def seeds(hits: DataFrame, sources: DataFrame, top_k: int) -> DataFrame:
    """``path, rank_ix``: ranked rows to pages; a page is itself, a chunk the page of its source (by raw path), others fall out.
    Of a path the best rank holds; ties by row id."""
    from pyspark.sql import Window

    ranked = hits.withColumn("ix", F.row_number().over(Window.orderBy("rank", "row_id")))  # at most 3 x top_k rows
    src = sources.dropDuplicates(["id"]).where("raw_path <> ''").groupBy("raw_path").agg(F.min("id").alias("source_page"))
    mapped = ranked.withColumn("raw_path", F.substring_index("row_id", "#", 1)).join(src, "raw_path", "left")
    page = F.when(F.col("kind") == "page", F.col("row_id")).otherwise(F.col("source_page"))
    return mapped.select(page.alias("id"), "ix").where("id is not null").groupBy("id").agg(F.min("ix").alias("rank_ix")).orderBy("rank_ix", "id").limit(top_k)


def contexts(pages: DataFrame, edges: DataFrame, seed: DataFrame, snippet: int = 240, most: int = 8) -> DataFrame:
    """``id, is_seed, score, snippet``: the seeds and the pages they link to, seeds first, then by score and id."""
    key = canonical_id(F.col("id"))
    s = cut(seed, "seeds").select(key.alias("key"), "score")
    linked = edges.join(broadcast_if_small(s.select(F.col("key").alias("src"), "score")), "src").select(F.col("dst").alias("key"), F.lit(False).alias("is_seed"), "score")
    every = s.select("key", F.lit(True).alias("is_seed"), "score").unionByName(linked).groupBy("key").agg(F.max("is_seed").alias("is_seed"), F.max("score").alias("score"))
    return (
        pages.dropDuplicates(["id"])
        .select(key.alias("key"), "id", F.substring(F.coalesce("body", F.lit("")), 1, max(80, snippet)).alias("snippet"))
        .join(every, "key")
        .select("id", "is_seed", "score", "snippet")
        .orderBy(F.desc("is_seed"), F.desc("score"), "id")
        .limit(most)
    )
