"""Extension points: retrieval providers, decomposers, verifiers and their checked outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.admission import duplicate_keys, reason_codes
from ..operators.audits import basis_codes, check_spans
from ..operators.lineage import ORIGINAL_KINDS, RELATION_KINDS, RELATION_STATUS, tree_paths

FRAGMENT = "target_id string, version_id string, fragment_id string, parent_id string, text string, start int, end int, quote string"
VERDICT = "target_id string, verdict string, evidence_count long, rationale string"

Provider = Callable[[DataFrame, DataFrame], DataFrame]
"""``provider(tasks, pool) -> returns(pool_id, version_id, task_id)``: any DataFrame function."""


def whole_text_fragments(targets: DataFrame, materials: DataFrame) -> DataFrame:
    """Conservative default: the whole text of a version is one fragment."""
    rows = targets.join(materials, "pool_id")
    return rows.select(
        "target_id", "version_id", F.concat("version_id", F.lit(":full")).alias("fragment_id"), F.col("target_id").alias("parent_id"),
        F.col("content").alias("text"), F.lit(0).alias("start"), F.length("content").alias("end"), F.col("content").alias("quote"))


def decompose(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str = FRAGMENT) -> DataFrame:
    """Run a decomposer over (target, version) rows in Arrow batches; it returns fragment rows."""
    def batches(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)
    return rows.mapInPandas(batches, schema)


def verify(evidence: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str = VERDICT) -> DataFrame:
    """Run a verifier once per target on that target's summary rows.

    The rows are aggregates per (target, version), never raw text, and a target
    whose pool is large is summarised before it gets here.
    """
    return evidence.groupBy("target_id").applyInPandas(fn, schema)


def verdict_summary(fragments: DataFrame, stances: DataFrame) -> DataFrame:
    """Per target and stance: supporting versions counted, the bounded input of a verifier."""
    rows = fragments.join(stances, "version_id")
    return rows.groupBy("target_id", "stance").agg(F.count_distinct("version_id").alias("versions"))


def annotated(items: DataFrame, annotations: DataFrame, key: list[str]) -> DataFrame:
    """Replay hand-made annotations; an item without one stays unresolved."""
    return items.join(annotations, key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("unresolved")))


def fragment_codes(fragments: DataFrame, materials: DataFrame) -> DataFrame:
    """Checks on decomposer output before it joins the graph: spans, unique ids, parent path."""
    spans = fragments.select(F.col("fragment_id").alias("finding_id"), "version_id", "start", "end", "quote")
    ok = check_spans(spans, materials).groupBy("finding_id").agg(F.bool_and("span_ok").alias("_span"))
    twice = duplicate_keys(fragments, ["target_id"], "fragment_id").withColumnRenamed("uses", "_uses")
    tree = tree_paths(fragments.select(F.col("target_id").alias("scope"), F.col("fragment_id").alias("id"), "parent_id").distinct(), F.col("scope"))
    rows = fragments.join(ok.withColumnRenamed("finding_id", "fragment_id"), "fragment_id", "left").join(
        twice, ["target_id", "fragment_id"], "left").join(
        tree.select(F.col("scope").alias("target_id"), F.col("id").alias("fragment_id"), F.col("valid").alias("_valid")).distinct(), ["target_id", "fragment_id"], "left")
    return rows.select("target_id", "fragment_id", reason_codes(
        (~F.coalesce("_span", F.lit(False)), "invalid_span"), (F.col("_uses").isNotNull(), "duplicate_id"),
        (~F.coalesce("_valid", F.lit(False)), "no_path_to_target")).alias("reasons"))


def relation_codes(relations: DataFrame, spans: DataFrame, materials: DataFrame) -> DataFrame:
    """Checks on relation output: vocabulary, endpoints, direct edges and the basis rule."""
    c = F.col
    basis = basis_codes(relations.select(c("relation_id").alias("finding_id"), c("from_version").alias("side")), check_spans(spans, materials), "side")
    known = materials.select(c("version_id").alias("to_version"), F.lit(True).alias("_known"))
    rows = relations.join(basis.select(c("finding_id").alias("relation_id"), c("reasons").alias("_basis")), "relation_id", "left").join(known, "to_version", "left")
    own = reason_codes(
        (~c("kind").isin(RELATION_KINDS), "invalid_kind"), (~c("status").isin(RELATION_STATUS), "invalid_status"),
        (c("to_version").isNotNull() & c("_known").isNull(), "unavailable_upstream"),
        ((c("status") == "direct") & c("to_version").isNull(), "direct_without_target"))
    return rows.select("relation_id", F.concat(own, F.coalesce("_basis", F.array().cast("array<string>"))).alias("reasons"))


def origin_codes(origins: DataFrame) -> DataFrame:
    """Checks on origin output: an explicit original kind and a rationale."""
    return origins.select("version_id", reason_codes(
        (~F.col("material_kind").isin(ORIGINAL_KINDS), "invalid_kind"), (F.trim("rationale") == "", "empty_rationale")).alias("reasons"))


__all__ = ["Provider", "annotated", "decompose", "fragment_codes", "origin_codes", "relation_codes",
           "verdict_summary", "verify", "whole_text_fragments"]
