"""References to records that do not exist, kept up to date incrementally.

State is held per key (a canonical id of a parent table), in tables bucketed by the key's hash: an index of parents and the
references with their status.  A batch of new references probes the index of their buckets; a batch of arriving or deleted parents
judges anew the references in the buckets of its keys.  ``snapshot`` counts the open references per table, field and month.

The state lies in the shared folder, so the loss of executors costs recomputation only.  A hot key is a hot key
of the probing side of a join with one row per key on the other side, which adaptive execution splits; nothing is gathered
per key.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import broadcast_if_small, shared_dir

REFS = "table_name string, field_name string, row_no bigint, target string, key string, ref_at timestamp"
PARENTS = "target string, key string, id string, first_at timestamp, gone_at timestamp"


def canonical_id(value: Column) -> Column:
    """Lower case, each run of characters other than a-z and 0-9 as one ``_``, outer ``_`` cut; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def references(rows: DataFrame, table: str, number: str, fields: dict[str, str]) -> DataFrame:
    """Rows of ``table`` to one reference per field; ``fields`` maps a field to the parent table it refers to.

    Null and blank ids (also ids without any letter or digit) are no references.  Only the named columns are read.
    """
    exploded = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(t).alias("target"), canonical_id(F.col(f)).alias("key")) for f, t in fields.items()]))
    return (
        rows.select(F.lit(table).alias("table_name"), F.col(number).cast("bigint").alias("row_no"), F.col("recorded_at").cast("timestamp").alias("ref_at"), exploded.alias("r"))
        .where("r.key <> ''")
        .select("table_name", "r.field_name", "row_no", "r.target", "r.key", "ref_at")
    )


def parents(rows: DataFrame, table: str) -> DataFrame:
    """Rows of a parent table as events ``target, key, id, first_at, gone_at``; blank ids are none."""
    return rows.select(
        F.lit(table).alias("target"), canonical_id(F.col("id")).alias("key"), F.col("id"), F.col("recorded_at").cast("timestamp").alias("first_at"), F.col("deleted_at").cast("timestamp").alias("gone_at")
    ).where("key <> ''")


BUCKETS = 8  # of the keys' hashes, by default; choose more for larger states: a batch rewrites only the buckets in which parents change
PARTS = 8  # files sets of a bucket from which on it is compacted

_INDEX = PARENTS + ", bucket int"
_REFS = REFS + ", kind string, epoch int, bucket int"


class OrphanState:
    """Keyed state of references and parents; ``advance`` takes one batch, ``current`` and ``snapshot`` report.

    kinds: ``missing`` (no such parent), ``deleted``, ``late`` (it arrived after the reference), null (resolved).

    The state is two tables under ``path``, bucketed by the hash of the key: the index of parents and the references with their
    status.  A batch appends its references to their buckets and rewrites the buckets in which parents change; then one small file,
    moved into place, names the parts that hold from now on and the batch.  A batch that fails half-way leaves no trace, one that
    comes again is passed over, and a new ``OrphanState`` of the same path goes on where the last one stopped.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/orphans-{uuid.uuid4().hex}").rstrip("/")
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.held: dict = self._load() or {"epoch": 0, "batch": None, "buckets": buckets, "index": {}, "refs": {}, "old": []}

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _load(self) -> dict | None:
        folder = self._hadoop(f"{self.path}/commits")
        names = sorted(x.getPath().getName() for x in self.fs.listStatus(folder)) if self.fs.exists(folder) else []
        names = [x for x in names if x.endswith(".json")]
        return json.loads(self.spark.read.text(f"{self.path}/commits/{names[-1]}", wholetext=True).first()[0]) if names else None

    def _commit(self, held: dict) -> None:
        target = f"{self.path}/commits/{held['epoch']:010d}.json"
        out = self.fs.create(self._hadoop(target + ".tmp"), True)
        out.write(bytearray(json.dumps(held), "utf-8"))
        out.close()
        if not self.fs.rename(self._hadoop(target + ".tmp"), self._hadoop(target)):
            raise RuntimeError(f"{target} is there already: another writer uses this state")
        self.held = held

    def _read(self, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table in some buckets, or in all."""
        parts: dict[str, list[int]] = {}  # folder of a batch to the buckets whose part there holds
        for b, folders in self.held[table].items():
            for folder in folders if buckets is None or int(b) in buckets else ():
                parts.setdefault(folder, []).append(int(b))
        if not parts:
            return self.spark.createDataFrame([], schema)
        frames = [self.spark.read.schema(schema + ", b int").parquet(f"{self.path}/{x}").where(F.col("b").isin(own)).drop("b") for x, own in sorted(parts.items())]
        return reduce(DataFrame.unionByName, frames)

    def _write(self, rows: DataFrame, table: str, epoch: int) -> dict[str, str]:
        """Write rows by bucket, hot buckets in several files; each bucket written with the folder of its new part."""
        folder = f"{table}/{epoch:010d}"
        rows.withColumn("b", F.col("bucket")).hint("rebalance", "b").write.mode("overwrite").partitionBy("b").parquet(f"{self.path}/{folder}")
        names = [x.getPath().getName() for x in self.fs.listStatus(self._hadoop(f"{self.path}/{folder}"))]
        return {n[2:]: folder for n in names if n.startswith("b=")}

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("target", "key"), F.lit(self.held["buckets"])).cast("int"))

    def advance(self, new_refs: DataFrame | None, new_parents: DataFrame | None, batch: int | None = None) -> None:
        """Probe new references; re-open, resolve or age old ones whose parents are in ``new_parents``.  A ``batch`` number that is not
        above the last one's has been taken already and changes nothing."""
        if batch is not None and self.held["batch"] is not None and batch <= self.held["batch"]:
            return
        held = json.loads(json.dumps(self.held))
        epoch = held["epoch"] = held["epoch"] + 1
        held["batch"] = batch if batch is not None else held["batch"]
        for old in held.pop("old"):  # what the last but one batch replaced
            self.fs.delete(self._hadoop(f"{self.path}/{old}"), True)
        held["old"] = []

        def replace(table: str, parts: dict[str, str], touched: list[int]) -> None:
            for b in touched:
                held["old"] += [f"{x}/b={b}" for x in held[table].pop(str(b), [])]
            for b, part in parts.items():
                held[table].setdefault(b, []).append(part)

        changed: list[int] = []
        if new_parents is not None:
            own = self._bucketed(new_parents)
            changed = [r.bucket for r in own.select("bucket").distinct().collect()]  # at most BUCKETS
            rows = self._read("index", _INDEX, changed).unionByName(own).groupBy("target", "key", "id", "first_at", "bucket").agg(F.max("gone_at").alias("gone_at"))
            replace("index", self._write(rows.select("target", "key", "id", "first_at", "gone_at", "bucket"), "index", epoch), changed)
        now = dict(self.held, index=held["index"])
        before, self.held = self.held, now
        try:
            redo = sorted({*changed, *(int(b) for b, x in held["refs"].items() if len(x) >= PARTS)})
            probes = [self._read("refs", _REFS, redo).drop("kind")] if any(str(b) in held["refs"] for b in redo) else []
            wanted = set(redo)
            if new_refs is not None:
                new = self._bucketed(new_refs).withColumn("epoch", F.lit(epoch))
                probes.append(new)
                wanted |= {r.bucket for r in new.select("bucket").distinct().collect()}
            if probes:
                # of several rows of a key the earliest arrival counts, and it is deleted only if all its rows are
                index = self._read("index", _INDEX, sorted(wanted))
                verdict = index.groupBy("target", "key").agg(F.min("first_at").alias("first_at"), F.bool_or(F.col("gone_at").isNull()).alias("live"))
                kind = F.when(F.col("live").isNull(), "missing").when(~F.col("live"), "deleted").when(F.col("first_at") > F.col("ref_at"), "late")
                columns = ["table_name", "field_name", "row_no", "target", "key", "ref_at"]
                refs = reduce(DataFrame.unionByName, [x.select(*columns, "epoch", "bucket") for x in probes])
                rows = refs.join(broadcast_if_small(verdict), ["target", "key"], "left").select(*columns, kind.alias("kind"), "epoch", "bucket")
                replace("refs", self._write(rows, "refs", epoch), redo)
        finally:
            self.held = before
        self._commit(held)

    def current(self) -> DataFrame:
        """``table_name, field_name, row_no, kind, ref_month`` of each reference that is not resolved; each counts once, by its latest
        delivery."""
        rows = self._read("refs", _REFS).groupBy("table_name", "field_name", "row_no").agg(F.max(F.struct("epoch", "kind", "ref_at")).alias("s"))
        return rows.where("s.kind is not null").select("table_name", "field_name", "row_no", "s.kind", F.date_format("s.ref_at", "yyyy-MM").alias("ref_month"))

    def snapshot(self) -> DataFrame:
        """Open references per table, field, month and kind."""
        return self.current().groupBy("table_name", "field_name", "ref_month", "kind").agg(F.count("*").alias("refs"))


def track(spark: SparkSession, refs: list[DataFrame], parent_rows: list[tuple[str, DataFrame]], cuts: list[str]) -> OrphanState:
    """Run history through the state in event order: at each instant in ``cuts`` and at the end.

    A parent arrives at its ``recorded_at`` and goes at its ``deleted_at``; rows without a time come with the last batch.
    """
    state = OrphanState(spark)
    all_refs = reduce(DataFrame.unionByName, refs)
    bounds = [None, *cuts, None]
    for n, (low, high) in enumerate(zip(bounds, bounds[1:])):

        def window(at: Column) -> Column:
            after = F.lit(True) if low is None else F.coalesce(at > F.lit(low).cast("timestamp"), F.lit(True))
            upto = F.lit(True) if high is None else F.coalesce(at <= F.lit(high).cast("timestamp"), F.lit(False))
            return after & upto

        batch = []
        for table, rows in parent_rows:
            known = rows.select("id", F.col("recorded_at").cast("timestamp").alias("recorded_at"), F.col("deleted_at").cast("timestamp").alias("deleted_at"))
            if high is not None:
                known = known.where(F.col("recorded_at") <= F.lit(high).cast("timestamp")).withColumn("deleted_at", F.when(F.col("deleted_at") <= F.lit(high).cast("timestamp"), F.col("deleted_at")))
            batch.append(parents(known.where(window(F.col("recorded_at")) | (F.col("deleted_at").isNotNull() & window(F.col("deleted_at")))), table))
        state.advance(all_refs.where(window(F.col("ref_at"))), reduce(DataFrame.unionByName, batch))
    return state


def even_cuts(rows: DataFrame, column: str, epochs: int) -> list[str]:
    """Instants that split the span of ``column`` into ``epochs`` equal parts; none for an empty table."""
    low, high = rows.agg(F.min(F.unix_timestamp(column)), F.max(F.unix_timestamp(column))).first()
    if low is None or high <= low:
        return []
    return [str(x[0]) for x in rows.sparkSession.createDataFrame([(int(low + (high - low) * k / epochs),) for k in range(1, epochs)], "s bigint").select(F.timestamp_seconds("s").cast("string")).collect()]
