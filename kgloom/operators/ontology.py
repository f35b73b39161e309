"""The ontology's object and link types, as plain values and as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Object types.
OBJECT_TYPES = ("Customer", "Product", "Person", "Concept", "Source", "Memo", "Decision")

# Link types with the object types allowed at their ends.
LINK_TYPES = {
    "works_at": (["Person"], ["Customer"]),
    "operates_in": (["Customer", "Product", "Person"], ["Customer", "Concept", "Product", "Person"]),
    "has_sla": (["Customer"], ["Concept"]),
    "owns": (["Person", "Customer", "Product"], ["Product"]),
    "derived_from": (["Customer", "Concept", "Person", "Product"], ["Customer", "Concept", "Source", "Product", "Person"]),
    "mentions": (["Source", "Customer", "Product", "Concept", "Person"], ["Customer", "Person", "Product", "Concept"]),
    "contradicts": (["Source", "Concept"], ["Source", "Concept"]),
    "part_of": (["Product", "Person", "Concept", "Customer"], ["Customer", "Product", "Concept"]),
    "cites_evidence": (["Memo"], ["Customer", "Person", "Product", "Concept", "Source", "Memo"]),
    "flags_concept": (["Memo"], ["Customer", "Concept", "Source"]),
    "targets": (["Memo", "Product"], ["Customer", "Concept", "Person", "Product"]),
    "triggered_by": (["Decision"], ["Memo", "Concept", "Customer", "Source"]),
    "justified_by": (["Decision"], ["Memo", "Concept", "Customer", "Person", "Product", "Source"]),
    "approved_by": (["Decision"], ["Person"]),
    "affects": (["Decision"], ["Customer", "Person", "Product", "Concept", "Memo"]),
    "precedes": (["Decision"], ["Decision"]),
}


def link_types(spark: SparkSession, specs: dict[str, tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """``type, domain, range``; an empty list allows anything."""
    return spark.createDataFrame([(k, a, b) for k, (a, b) in (specs or LINK_TYPES).items()], "type string, domain array<string>, range array<string>")


def object_types(spark: SparkSession, names: tuple[str, ...] = OBJECT_TYPES) -> DataFrame:
    return spark.createDataFrame([(x,) for x in names], "type string")
