"""Decision records from event logs: projection, precedent ranking and point-in-time replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_list

# Fields a page's time is read from and decision classes by prefix of the action.
CLASSES = [("flag_", "review_flag"), ("publish_", "publication"), ("create_", "operational_write"), ("trigger_", "operational_write"), ("file_", "synthesis"), ("run_", "synthesis")]


def decision_class(action: Column) -> Column:
    out = F.lit("other")
    for prefix, name in reversed(CLASSES):
        out = F.when(action.startswith(prefix), name).otherwise(out)
    return out


def decision_id(action: Column, actor: Column, ts: Column) -> Column:
    """``decision_{action}_{actor}_{first 18 digits of the time}``"""
    return F.concat_ws("_", F.lit("decision"), action, actor, F.substring(F.regexp_replace(ts, "[^0-9]", ""), 1, 18))


def from_events(events: DataFrame) -> DataFrame:
    """``id, ts, actor, action, decision_class, entity, k``: one decision per distinct event; repeats of an id come once.

    Events without a type or time give none; a props text that is no JSON gives a null ``k``.
    """
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    own = events.where("event_type is not null and ts is not null").select(
        F.concat(F.lit("flag_"), "event_type").alias("action"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), ts.alias("ts"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "value"
    )
    return (
        own.select(decision_id(F.col("action"), F.col("actor"), F.col("ts")).alias("id"), "ts", "actor", "action", decision_class(F.col("action")).alias("decision_class"), F.concat(F.lit("entity_"), F.col("k").cast("string")).alias("entity"), "value")
        .groupBy("id")
        .agg(F.min(F.struct("ts", "actor", "action", "decision_class", "entity", "value")).alias("d"))
        .select("id", "d.*")
    )


def backfill(decisions: DataFrame, existing: DataFrame) -> DataFrame:
    """The decisions that are not there yet, by id."""
    return decisions.join(existing.select("id"), "id", "left_anti")


def precedents(decisions: DataFrame, entities: list[str], *, cls: str | None = None, action: str | None = None, limit: int = 5, exclude: str | None = None, hard: bool = True) -> DataFrame:
    """``id, ts, score``: 3 for a shared entity, 2 for the class and 1.5 for the action; newest first among equals, then by id.

    Class and action filter if ``hard``; rows without a score fall out.
    """
    score = F.when(F.col("entity").isin(entities), 3.0).otherwise(0.0) if entities else F.lit(0.0)
    if cls:
        score = score + F.when(F.col("decision_class") == cls, 2.0).otherwise(0.0)
    if action:
        score = score + F.when(F.col("action") == action, 1.5).otherwise(0.0)
    own = decisions if exclude is None else decisions.where(F.col("id") != exclude)
    if hard and cls:
        own = own.where(F.col("decision_class") == cls)
    if hard and action:
        own = own.where(F.col("action") == action)
    return own.select("id", "ts", score.alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("ts"), "id").limit(limit)


def live_at(pages: DataFrame, cutoff: str, strict: bool = False) -> DataFrame:
    """Pages live at an instant: the first readable of ``updated`` and ``recorded_at`` is not later; pages without a readable time are
    live unless ``strict``.  Deleted pages are live until their ``deleted_at``."""
    at = F.coalesce(F.try_to_timestamp("updated"), F.col("recorded_at").cast("timestamp"))
    instant = F.lit(cutoff).cast("timestamp")
    shown = F.coalesce(at <= instant, F.lit(not strict))
    return pages.where(shown & (F.col("deleted_at").isNull() | (F.col("deleted_at") > instant)))


def replay(pages: DataFrame, cutoff: str) -> DataFrame:
    """``bucket, live, total``: pages per folder at the cutoff and in all, folders without live pages included."""
    own = pages.groupBy("id").agg(F.min(F.struct("path", "updated", "recorded_at", "deleted_at")).alias("p")).select("id", "p.*")
    bucket = F.coalesce(F.nullif(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.lit("")), F.lit("other"))
    live = live_at(own, cutoff).select("id", F.lit(1).alias("is_live"))
    return own.join(live, "id", "left").groupBy(bucket.alias("bucket")).agg(F.count("is_live").alias("live"), F.count("*").alias("total"))


def review_queue(events: DataFrame) -> DataFrame:
    """``concept_id, reason, ts``: the first flag of each concept and reason; later ones are repeats."""
    own = events.where("event_type is not null").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("concept_id"), F.col("event_type").alias("reason"), "ts")
    return own.groupBy("concept_id", "reason").agg(F.min("ts").alias("ts"))


def sources_of(pages: DataFrame) -> DataFrame:
    """``id, source``: the cited sources of each page, in order, once."""
    return pages.dropDuplicates(["id"]).select("id", F.explode(F.array_distinct(json_list("source_ids"))).alias("source"))


# Inputs whose value is an id the decision affects, in the order they are read; an actor approves it.
AFFECTING = ("target_entity", "concept_id", "supplier_id", "customer_id", "actor", "page_id", "entity_id", "name")


def full_class(action: Column, approved: Column) -> Column:
    """The class of a decision, that of written records with whether it was approved."""
    plain = decision_class(action)
    return F.when(plain == "operational_write", F.concat(plain, F.when(F.coalesce(approved, F.lit(False)), "_approved").otherwise("_unapproved"))).otherwise(plain)


def links_of_inputs(decisions: DataFrame, inputs: str = "inputs", cites: str = "cites", flagged: str = "flagged") -> DataFrame:
    """``id, dst, type``: what a decision affects, is approved and justified by, from its ``inputs`` (map of texts) and the lists
    ``cites`` and ``flagged``; each once.  Values other than letters, digits, ``_`` and ``-`` with at least one letter or digit are no
    ids; null maps and lists have none."""
    plausible = lambda v: v.rlike(r"^[\p{L}\p{N}_-]*[\p{L}\p{N}][\p{L}\p{N}_-]*$")
    link = lambda v, kind: F.struct(v.alias("dst"), F.lit(kind).alias("type"))
    own = F.filter(F.array(*[link(F.element_at(inputs, F.lit(k)), "approved_by" if k == "actor" else "affects") for k in AFFECTING]), lambda x: plausible(x["dst"]))
    listed = lambda name, kind: F.transform(F.filter(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda v: v.isNotNull()), lambda v: link(v, kind))
    every = F.concat(F.coalesce(own, F.array().cast("array<struct<dst:string,type:string>>")), listed(cites, "justified_by"), listed(flagged, "affects"))
    return decisions.select("id", F.explode(F.array_distinct(every)).alias("l")).select("id", "l.*").distinct()


def precedents_by_links(decisions: DataFrame, links: DataFrame, entities: list[str], *, cls: str | None = None, action: str | None = None, limit: int = 5) -> DataFrame:
    """``id, ts, overlap, score``: 3 for each entity that a decision (``id, ts, action, decision_class, approved, ok``) affects or is
    justified by (``id, dst, type``), 2 for the class, 1.5 for the action, 0.5 each if it was approved and went well; class and action
    filter.  Newest first among equals, then by id."""
    shared = links.where(F.col("type").isin("affects", "justified_by") & F.col("dst").isin(entities)).select("id", "dst").distinct().groupBy("id").agg(F.count("*").alias("overlap"))
    own = decisions
    if cls:
        own = own.where(F.col("decision_class") == cls)
    if action:
        own = own.where(F.col("action") == action)
    score = 3.0 * F.col("overlap") + (2.0 if cls else 0.0) + (1.5 if action else 0.0) + F.when(F.col("approved"), 0.5).otherwise(0.0) + F.when(F.col("ok"), 0.5).otherwise(0.0)
    scored = own.join(shared, "id", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0))).select("id", "ts", "overlap", score.alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), F.desc("ts"), "id").limit(limit)


def backfill_counts(decisions: DataFrame, existing: DataFrame) -> DataFrame:
    """``considered, written, skipped``: one row."""
    marked = decisions.select("id").distinct().join(existing.select("id", F.lit(1).alias("there")).distinct(), "id", "left")
    return marked.agg(F.count("*").alias("considered"), F.count_if(F.col("there").isNull()).alias("written"), F.count("there").alias("skipped"))


def replay_report(pages: DataFrame, cutoff: str, buckets: tuple[str, ...]) -> DataFrame:
    """``bucket, live, total, newest``: the replay of all named buckets, empty ones with zeros, and the newest live pages' time."""
    own = pages.groupBy("id").agg(F.min(F.struct("type", "updated", "recorded_at", "deleted_at")).alias("p")).select("id", "p.*")
    live = live_at(own, cutoff).select("id", F.lit(1).alias("is_live"))
    counts = own.join(live, "id", "left").groupBy(F.col("type").alias("bucket")).agg(
        F.count("is_live").alias("live"), F.count("*").alias("total"), F.max(F.when(F.col("is_live") == 1, F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss"))).alias("newest")
    )
    named = pages.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string")
    return named.join(counts, "bucket", "left").select("bucket", F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("total", F.lit(0)).alias("total"), "newest")
