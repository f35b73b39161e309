"""Record tables to typed entities and links, by a manifest compiled to column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug_ascii

_PLACE = re.compile(r"\{([^}|]+)(?:\|([a-z_]+))?\}")


def template(spec: str, columns: list[str]) -> Column:
    """``{column|transform}`` templates: slug (the default), email_local, lower, raw.  An empty value gives ``row``; a column
    that is not there is an error."""
    parts: list[Column] = []
    at = 0
    for m in _PLACE.finditer(spec):
        name, how = m[1].strip(), m[2] or "slug"
        if name not in columns:
            raise ValueError(f"template names a missing column: {name}")
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        value = {"slug": slug_ascii, "email_local": lambda v: slug_ascii(F.substring_index(v, "@", 1)), "lower": F.lower, "raw": lambda v: v}[how](value)
        parts += [F.lit(spec[at : m.start()]), F.when(value == "", "row").otherwise(value)]
        at = m.end()
    return F.concat(*parts, F.lit(spec[at:]))


def validate(manifest: dict, object_types: list[str], link_types: list[str]) -> list[str]:
    """What is wrong with a manifest: unknown target type, unknown link types, no identity."""
    out = [] if manifest.get("target_type") in object_types else [f"unknown target type {manifest.get('target_type')}"]
    if not manifest.get("identity"):
        out.append("no identity")
    return out + [f"unknown link type {x['type']}" for x in manifest.get("links", []) if x["type"] not in link_types]


def entities(rows: DataFrame, manifest: dict) -> DataFrame:
    """``id, type, name, source``: primary and secondary entities of each row.

    Rows whose required columns are null or blank give none; entities met in several rows come once, with the sorted union of
    their rows' citations.
    """
    own = _complete(rows, manifest)
    cite = template(manifest["citation"], own.columns)
    specs = [(manifest["identity"], manifest["target_type"], manifest["name"]), *[(x["to"], x["to_type"], x["name"]) for x in manifest.get("links", [])]]
    every = F.explode(F.array(*[F.struct(template(i, own.columns).alias("id"), F.lit(t).alias("type"), F.col(n).cast("string").alias("name")) for i, t, n in specs]))
    per = own.select(every.alias("e"), cite.alias("source")).select("e.*", "source")
    return per.groupBy("id", "type").agg(F.min("name").alias("name"), F.count_distinct("source").alias("rows"))


def links(rows: DataFrame, manifest: dict) -> DataFrame:
    """``src, dst, type`` of each complete row, repeats removed."""
    own = _complete(rows, manifest)
    me = template(manifest["identity"], own.columns)
    each = []
    for x in manifest.get("links", []):
        other = template(x["to"], own.columns)
        each.append(F.struct((other if x.get("from_other") else me).alias("src"), (me if x.get("from_other") else other).alias("dst"), F.lit(x["type"]).alias("type")))
    return own.select(F.explode(F.array(*each)).alias("l")).select("l.*").distinct()


def _complete(rows: DataFrame, manifest: dict) -> DataFrame:
    need = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in manifest.get("required", [])]
    return rows.where(reduce(lambda a, b: a & b, need)) if need else rows


def content_hash(rows: DataFrame) -> DataFrame:
    """``content_hash``: one SHA-256 of a table that does not depend on the order of rows or columns.

    Each row is its ``column=value`` pairs in order of name, with nulls as empty; the rows' own hashes are summed in two
    unsigned halves per task and the sums are hashed, so no task gathers the rows.  The same rows twice give another hash.
    """
    line = F.concat_ws("\x01", *[F.concat(F.lit(f"{c}="), F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in sorted(rows.columns)])
    return rows.select(line.alias("line")).select(F.sha2("line", 256).alias("h")).agg(
        F.sha2(F.concat_ws(":", *[F.coalesce(F.sum(F.conv(F.substring("h", i, 12), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in (1, 13, 25, 37, 49)], F.count("*").cast("string")), 256).alias("content_hash")
    )


def exact_content_hash(rows: DataFrame) -> DataFrame:
    """``content_hash``: SHA-256 over the sorted rows, as small record tables have it (one file's rows; the rows are gathered)."""
    line = F.concat_ws("\x01", *[F.concat(F.lit(f"{c}="), F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in sorted(rows.columns)])
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\x02"), 256).alias("content_hash"))


def bodies(rows: DataFrame, manifest: dict) -> DataFrame:
    """``id, body``: the page of each complete row, its citation and its filled columns as bullets in order of name; of several rows of an
    id the smallest text holds."""
    own = _complete(rows, manifest)
    value = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    bullets = F.filter(F.array(*[F.when(value(c) != "", F.concat(F.lit(f"- **{c}**: "), value(c))) for c in sorted(rows.columns)]), lambda x: x.isNotNull())
    text = F.concat(F.lit(f"_{manifest['target_type']} record imported from `"), template(manifest["citation"], own.columns), F.lit("`._\n"), F.array_join(F.concat(F.array(F.lit("")), bullets), "\n"))
    return own.select(template(manifest["identity"], own.columns).alias("id"), text.alias("body")).groupBy("id").agg(F.min("body").alias("body"))


def overview(rows: DataFrame, manifest: dict) -> DataFrame:
    """``rows, complete, columns``: one row; the columns are joined in order of name."""
    done = _complete(rows, manifest).agg(F.count("*").alias("complete")).withColumn("one", F.lit(1))
    every = rows.agg(F.count("*").alias("rows")).withColumn("one", F.lit(1))
    return every.join(done, "one").select("rows", "complete", F.lit(",".join(sorted(rows.columns))).alias("columns"))


def ingest(rows: DataFrame, manifest: dict, held: DataFrame) -> DataFrame:
    """``id, body, content_hash``: the pages of the rows that are new, or whose text differs from the one ``held`` (``id,
    content_hash``); a second run over the same rows gives none."""
    own = bodies(rows, manifest).withColumn("content_hash", F.sha2("body", 256))
    return own.join(held.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
