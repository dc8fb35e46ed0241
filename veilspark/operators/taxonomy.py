"""Policies: what a type is called in them, how important it is for a kind of document, and what follows.

A policy is a table (document_type, name, priority); names and aliases are small tables
that every task gets. Priorities of all types and document types are worked out once, as
one table, so spans need a single broadcast join. Policies of single document types
and further names come from files (``load``); the general policy is built in.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.functions import vocabulary as V

MASKED = ("MUST_HAVE", "NICE_TO_HAVE")


def load(spark: SparkSession, path: str) -> DataFrame:
    """A policy table from JSON lines or CSV with a header: document_type, name, priority."""
    ddl = "document_type string, name string, priority string"
    return spark.read.schema(ddl).json(path) if path.endswith((".json", ".jsonl")) else spark.read.schema(ddl).option("header", True).csv(path)


def document_type(hint: Column, types: tuple[str, ...] = V.DOCUMENT_TYPES) -> Column:
    """The policy's document type for a hint: its own name, a short name, or the first that holds it or is held by it; else null."""
    name = F.trim(hint)
    short = F.regexp_replace(F.lower(name), r"[\s/_\-]+", "_")
    alias = F.try_element_at(F.create_map(*[F.lit(x) for kv in V.DOCUMENT_ALIASES.items() for x in kv]), short)
    holds = [F.when(F.contains(F.lit(t.lower()), F.lower(name)) | F.contains(F.lower(name), F.lit(t.lower())), F.lit(t)) for t in types]
    return F.when(F.length(hint) > 0, F.coalesce(F.when(name.isin(*types), name), alias, *holds))


def policy_name(entity_type: Column, names: dict[str, str] | None = None) -> Column:
    """What a type is called in policies: by the detectors' names, by ``names``, or as it is."""
    clean = F.upper(F.trim(entity_type))
    found = [F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), clean) for m in (V.POLICY_NAMES, names or {}) if m]
    return F.coalesce(*found, clean)


def _words(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(name, F.lit(r"\b[A-Z0-9]+\b"), F.lit(0)))


def general_policy(spark: SparkSession) -> DataFrame:
    rows = [(n, p) for p, names in (("MUST_HAVE", V.MUST_HAVE), ("NICE_TO_HAVE", V.NICE_TO_HAVE), ("DROP", V.DROP)) for n in names]
    return spark.createDataFrame(rows, "name string, general string")


def priorities(types: DataFrame, policies: DataFrame | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """document_type, entity_type, priority for each row of types (document_type, entity_type).

    A document's own policy goes first: the same name, else the first entry
    (``name`` order) that has all of its words. Then the general policy, then NICE_TO_HAVE.
    """
    spark = types.sparkSession
    asked = types.distinct().withColumn("name", policy_name(F.col("entity_type"), names)).withColumn("known", document_type(F.col("document_type")))
    asked = asked.join(F.broadcast(general_policy(spark)), "name", "left")  # about a hundred rows
    if policies is None:
        return asked.select("document_type", "entity_type", F.coalesce("general", F.lit("NICE_TO_HAVE")).alias("priority"))
    own = policies.select(F.col("document_type").alias("known"), F.col("name").alias("entry"), F.col("priority").alias("own"))
    fits = (F.col("entry") == F.col("name")) | ((F.size(_words(F.col("name"))) > 0) & (F.size(F.array_except(_words(F.col("name")), _words(F.col("entry")))) == 0))
    rank = F.row_number().over(Window.partitionBy("document_type", "entity_type").orderBy((F.col("entry") != F.col("name")).cast("int"), "entry"))
    best = asked.join(own, "known").where(fits).withColumn("r", rank).where("r = 1").select(F.col("document_type").alias("d_"), F.col("entity_type").alias("t_"), "own")
    out = asked.join(best, F.col("document_type").eqNullSafe(F.col("d_")) & (F.col("entity_type") == F.col("t_")), "left")
    return out.select("document_type", "entity_type", F.coalesce("own", "general", F.lit("NICE_TO_HAVE")).alias("priority"))


def apply(spans: DataFrame, policies: DataFrame | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Spans (with document_type) with priority and should_mask. DROP spans go where the document's type is given; without one nothing is dropped."""
    table = priorities(spans.select("document_type", "entity_type"), policies, names)
    p = table.select(F.col("document_type").alias("d_"), F.col("entity_type").alias("t_"), "priority")
    out = spans.join(F.broadcast(p), F.col("document_type").eqNullSafe(F.col("d_")) & (F.col("entity_type") == F.col("t_")), "left").drop("d_", "t_")
    out = out.withColumn("should_mask", F.col("priority").isin(*MASKED))
    return out.where((F.col("priority") != "DROP") | (F.coalesce("document_type", F.lit("")) == ""))


def targets(spark: SparkSession, hint: str | None = None, policies: DataFrame | None = None) -> DataFrame:
    """name, priority of what detectors look for in a kind of document: its own policy's entries, or the general policy's."""
    known = _known(hint)
    if policies is not None and known is not None:
        own = policies.where(F.col("document_type") == known)
        return own.where(F.col("priority").isin(*MASKED)).select("name", "priority").distinct()
    return general_policy(spark).where(F.col("general").isin(*MASKED)).select("name", F.col("general").alias("priority"))


def _known(hint: str | None) -> str | None:
    if not hint:
        return None
    name = hint.strip()
    if name in V.DOCUMENT_TYPES:
        return name
    alias = V.DOCUMENT_ALIASES.get(re.sub(r"[\s/_\-]+", "_", name.lower()))
    return alias or next((t for t in V.DOCUMENT_TYPES if name.lower() in t.lower() or t.lower() in name.lower()), None)
