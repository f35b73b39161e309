"""Writers: graph snapshot, GraphML, catalog, markdown pages and idempotent appends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot(frames: dict[str, DataFrame], path: str) -> None:
    """All frames as JSON lines tagged with their kind, replacing the folder."""
    tagged = [df.withColumn("kind", F.lit(k)) for k, df in frames.items()]
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).write.mode("overwrite").json(path)


def graphml(node: DataFrame, edge: DataFrame, path: str) -> None:
    """Nodes and edges as GraphML elements, one a line; an edge's id is a hash of its place in the bag of edges."""
    from ..operators.graph import graphml_nodes

    e = edge.select(F.concat(F.lit('<edge source="'), "src", F.lit('" target="'), "dst", F.lit('"><data key="type">'), "type", F.lit("</data></edge>")).alias("xml"))
    graphml_nodes(node).select("xml").unionByName(e).write.mode("overwrite").text(path)


def catalog(entries: DataFrame, path: str) -> None:
    """Catalog entries in order, range-partitioned, so that the files in order are the catalog."""
    entries.repartitionByRange("ord", "type", "sort_title", "id").sortWithinPartitions("ord", "type", "sort_title", "id").select(F.col("entry").alias("value")).write.mode("overwrite").text(path)


def page_text(*fields: str) -> Column:
    """A page as frontmatter of JSON values and body."""
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(F.to_json(F.struct(F.col(f).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(f).alias("v")))) - 6), F.lit("null"))) for f in fields]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.coalesce("body", F.lit("")))


def append_new(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys are not in the table at ``path`` yet, each key once; returns what was appended."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(keys)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        new = new.join(spark.read.schema(rows.schema).parquet(path).select(*keys).distinct(), keys, "left_anti")
    from ..plans.materialize import cut

    done = cut(new, "append")
    done.write.mode("append").parquet(path)
    return done
