"""The knowledge base on disk: an inverted index of texts that questions read by term, kept up to date by fingerprints.

``build`` writes postings, bucketed by the hash of the term, and the lengths of all texts; a question reads the buckets of its terms
and one row of statistics, never the texts.  An index is built anew only when the fingerprint of its files has changed, and its
mark is written last, so that an index that was not finished is never read.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.materialize import cut, shared_dir, spread
from .retrieval import K1, B, query_terms

TERM_BUCKETS = 16  # of the hashes of terms, by default; a question reads at most one bucket a term


def fingerprint(df: DataFrame) -> str:
    """SHA-256 over path, size and time of the files a frame reads, in order of path."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = hashlib.sha256()
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        total.update(f"{name}\0{status.getLen()}\0{status.getModificationTime()}\n".encode())
    return total.hexdigest()


def build(docs: DataFrame, key: str, text: str, path: str, buckets: int = TERM_BUCKETS) -> None:
    """Write the index of ``docs`` to ``path``: ``postings`` (``term, key, tf, dl``), by bucket of the term, and ``stats`` (``n, avgdl``).

    Keys given twice count once; null and empty texts have no postings but count as documents.  A hot term's bucket is written by many
    tasks.
    """
    own = cut(spread(docs.select(F.col(key).alias("key"), F.col(text).alias("_text"))).select("key", tokens("_text").alias("t")).dropDuplicates(["key"]), "tokens")
    per = own.select("key", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("key", "dl", "term").agg(F.count("*").alias("tf"))
    per.withColumn("b", _bucket(F.col("term"), buckets)).hint("rebalance", "b").write.mode("overwrite").partitionBy("b").parquet(f"{path}/postings")
    own.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/stats")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def opened(docs: DataFrame, key: str, text: str) -> str:
    """The path of the index of a table's column, built now if there is none of the same files."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/kb-{hashlib.sha256(f'{fingerprint(docs)}{key}{text}'.encode()).hexdigest()[:32]}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/DONE")
    fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(mark):
        build(docs, key, text, path)
        fs.create(mark, True).close()
    return path


def bm25(docs: DataFrame, key: str, text: str, question: str, top_k: int | None = 5) -> DataFrame:
    """``key, score``: as :func:`retrieval.bm25`, from the index."""
    terms = query_terms(question)
    path = opened(docs, key, text)
    spark = docs.sparkSession
    stats = spark.read.parquet(f"{path}/stats").first()
    kind = docs.schema[key].dataType.simpleString()
    none = spark.createDataFrame([], f"`{key}` {kind}, score double")
    if not terms or not stats["n"] or not stats["avgdl"]:
        return none
    hashes = spark.createDataFrame([(w,) for w in terms], "term string").select("term", _bucket(F.col("term"), stats["buckets"]).alias("b")).collect()
    hits = spark.read.schema(f"key {kind}, dl int, term string, tf bigint, b int").parquet(f"{path}/postings").where(F.col("b").isin([r.b for r in hashes]) & F.col("term").isin(list(terms)))
    df = {r.term: r.df for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}  # one row a term
    weight = reduce(lambda c, w: c.when(F.col("term") == w, F.lit(terms[w] * math.log(1 + (stats["n"] - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)))), terms, F.when(F.lit(False), F.lit(0.0)))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.greatest("dl", F.lit(1)) / F.lit(stats["avgdl"])))
    scored = hits.groupBy(F.col("key").alias(key)).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return scored if top_k is None else scored.orderBy(F.desc("score"), key).limit(top_k)
