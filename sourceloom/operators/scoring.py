"""Predictions against gold: counters per case, then ratios and calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .admission import LABELS

# Normal quantile of the 95% interval, score weights, metric direction.
Z95 = 1.959963984540054
WEIGHTS = {"VP": .25, "FR": .20, "TR": .15, "SR": .15, "EN": .15, "CA": .10}
LOWER_IS_BETTER = ["HFAR", "unknown_source_false_promotion", "ECE10"]
# Each ratio metric as (numerator counter, denominator counter).
RATIOS = {
    "VP": ("accepted_true", "accepted"), "FR": ("blocked_false", "false"), "TR": ("accepted_true", "true"),
    "SR": ("source_correct", "traceable"), "EN": ("support_correct", "support_claims"),
    "HFAR": ("accepted_high_false", "high_false"),
    "source_precision": ("source_correct", "source_resolved"),
    "unknown_source_false_promotion": ("false_root", "untraceable"),
    "edge_precision": ("edges_correct", "edges_predicted"),
    "annotated_edge_recall": ("edges_correct", "edges_gold"),
    "evidence_support_recall": ("support_correct", "gold_supports"),
    "stance_accuracy": ("stance_correct", "evidence_reported"),
    "false_identification_recall": ("false_identified", "false"),
    "classification_accuracy": ("correct_label", "cases"), "admission_coverage": ("accepted", "cases")}
COUNTERS = sorted({c for pair in RATIOS.values() for c in pair})
PAIR_COUNTERS = ["duplicate_tp", "duplicate_fp", "duplicate_fn"]
BINS = 10


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null, never zero, on an empty denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def wilson(numerator: Column, denominator: Column) -> Column:
    """Struct (low, high) of the 95% Wilson interval, null on an empty denominator."""
    n, z = denominator.cast("double"), F.lit(Z95)
    p = ratio(numerator, denominator)
    div = 1 + F.try_divide(z * z, n)
    centre = F.try_divide(p + F.try_divide(z * z, 2 * n), div)
    radius = F.try_divide(z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(z * z, 4 * n * n)), div)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - radius).alias("low"),
                                  F.least(F.lit(1.0), centre + radius).alias("high")))


def coverage(gold: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Problem rows of the fixed case set: missing, extra, duplicate or different cutoff."""
    g = gold.groupBy(key).agg(F.count(F.lit(1)).alias("g"), F.min("as_of").alias("g_at"))
    p = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("p"), F.min("as_of").alias("p_at"))
    joined = g.join(p, key, "full_outer")
    problem = (F.when(F.col("p").isNull(), "missing_prediction").when(F.col("g").isNull(), "extra_prediction")
               .when((F.col("g") > 1) | (F.col("p") > 1), "duplicate_case")
               .when(F.col("g_at") != F.col("p_at"), "cutoff_mismatch"))
    return joined.select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def unjudged(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted ids that no gold row judges; their cases are not to be scored before adjudication.  Null keys match nothing."""
    return predicted.select(*keys).distinct().join(gold.select(*keys).distinct(), keys, "left_anti")


def case_counters() -> dict[str, Column]:
    """0/1 counters of the admission decision from truth, decision and high_risk."""
    c = F.col
    admitted, false = c("decision") == "true", c("truth") == "false"
    high_false = c("high_risk") & false
    flags = {
        "cases": F.lit(True), "accepted": admitted, "true": c("truth") == "true", "false": false,
        "accepted_true": admitted & (c("truth") == "true"), "blocked_false": ~admitted & false,
        "high_false": high_false, "accepted_high_false": admitted & high_false,
        "correct_label": c("decision") == c("truth"), "false_identified": false & (c("decision") == "false")}
    return {k: v.cast("long") for k, v in flags.items()}


def reached_roots(cases: DataFrame, edges: DataFrame, start: Column) -> DataFrame:
    """Nodes reachable from a case's own node over the case's edges (small, bounded graphs per case)."""
    from .lineage import reach
    starts = cases.select(F.col("id").alias("scope"), start.alias("start"))
    return reach(starts, edges.select(F.col("id").alias("scope"), F.col("from").alias("src"), F.col("to").alias("dst"))).select(F.col("scope").alias("id"), "node")


def source_counters(cases: DataFrame, gold_edges: DataFrame, pred_edges: DataFrame, start: Column) -> DataFrame:
    """Per case: resolved, traceable and whether the claimed roots are right.

    Right means one acceptable root set is matched exactly, every predicted edge
    is annotated and every root is reachable over the predicted edges.
    """
    key = ["id", "from", "to", "relation"]
    matched = pred_edges.join(gold_edges.select(*key).withColumn("_hit", F.lit(1)), key, "left")
    edges = matched.groupBy("id").agg(F.count("_hit").alias("edges_correct"), F.count(F.lit(1)).alias("edges_predicted"))
    gold = gold_edges.groupBy("id").agg(F.count(F.lit(1)).alias("edges_gold"))
    wanted = cases.select("id", F.explode("roots").alias("node"))
    found = wanted.join(reached_roots(cases, pred_edges, start), ["id", "node"], "left_semi") \
        .groupBy("id").agg(F.count(F.lit(1)).alias("roots_reached"))
    out = cases.join(edges, "id", "left").join(gold, "id", "left").join(found, "id", "left").fillna(
        0, ["edges_correct", "edges_predicted", "edges_gold", "roots_reached"])
    resolved = F.col("source_status") == "resolved"
    sets_match = F.exists("acceptable_roots", lambda a: F.array_sort(a) == F.array_sort(F.col("roots")))
    correct = (resolved & F.col("traceable") & sets_match & (F.col("edges_correct") == F.col("edges_predicted"))
               & (F.col("roots_reached") == F.size("roots")))
    return out.withColumns({
        "source_correct": correct.cast("long"), "source_resolved": resolved.cast("long"),
        "false_root": (resolved & ~F.col("traceable")).cast("long"), "untraceable": (~F.col("traceable")).cast("long"),
    }).withColumn("traceable", F.col("traceable").cast("long"))


def evidence_counters(evidence: DataFrame) -> DataFrame:
    """Per case: stance agreement over judged evidence rows."""
    reported, right = F.col("reported"), F.col("stance") == F.col("gold_stance")
    supports = F.col("stance") == "supports"
    return evidence.groupBy("id").agg(
        F.count_if(F.col("gold_stance") == "supports").alias("gold_supports"),
        F.count_if(reported).alias("evidence_reported"), F.count_if(reported & right).alias("stance_correct"),
        F.count_if(reported & supports).alias("support_claims"),
        F.count_if(reported & supports & right).alias("support_correct"))


def pair_counters(evidence: DataFrame, scope: str = "id") -> DataFrame:
    """True, false and missed duplicate pairs per case, counted without listing a pair.

    Pairs inside a group of n rows number n(n-1)/2, so cell counts over
    (gold origin, predicted origin) give all three totals.
    """
    pairs = lambda n: (n * (n - 1) / 2).cast("long")
    cells = evidence.groupBy(scope, "gold_origin", "origin").agg(F.count(F.lit(1)).alias("n"))
    same_both = cells.filter("origin IS NOT NULL").groupBy(scope).agg(F.sum(pairs(F.col("n"))).alias("tp"))
    same_gold = cells.groupBy(scope, "gold_origin").agg(F.sum("n").alias("n")).groupBy(scope).agg(
        F.sum(pairs(F.col("n"))).alias("gold"))
    same_pred = cells.filter("origin IS NOT NULL").groupBy(scope, "origin").agg(F.sum("n").alias("n")).groupBy(scope).agg(
        F.sum(pairs(F.col("n"))).alias("pred"))
    out = same_gold.join(same_both, scope, "left").join(same_pred, scope, "left").fillna(0)
    return out.select(scope, F.col("tp").alias("duplicate_tp"), (F.col("pred") - F.col("tp")).alias("duplicate_fp"),
                      (F.col("gold") - F.col("tp")).alias("duplicate_fn"))


def calibration_columns() -> dict[str, Column]:
    """Squared error, top confidence, its correctness and its bin, from p_<label> columns."""
    terms = [(F.col(f"p_{l}") - (F.col("truth") == l).cast("double")) ** 2 for l in LABELS]
    top = F.greatest(*[F.col(f"p_{l}") for l in LABELS])
    label = reduce(lambda acc, l: acc.when(F.col(f"p_{l}") == top, l), LABELS[1:], F.when(F.col(f"p_{LABELS[0]}") == top, LABELS[0]))
    return {"brier": reduce(lambda a, b: a + b, terms), "confidence": top,
            "top_correct": (label == F.col("truth")).cast("long"),
            "bin": F.least(F.lit(BINS - 1), F.floor(top * BINS)).cast("int")}


def case_facts(cases: DataFrame, gold_edges: DataFrame, pred_edges: DataFrame, evidence: DataFrame, start: Column) -> DataFrame:
    """One wide row of additive counters per case; every metric is a function of their sums."""
    rows = source_counters(cases, gold_edges, pred_edges, start)
    rows = rows.withColumns({**case_counters(), **calibration_columns()})
    rows = rows.join(evidence_counters(evidence), "id", "left").join(pair_counters(evidence), "id", "left")
    sums = [*COUNTERS, *PAIR_COUNTERS]
    return rows.fillna(0, sums).select("id", "event_id", *sums, "brier", "confidence", "top_correct", "bin")


def counter_sums(weight: Column | None = None) -> list[Column]:
    """Aggregates of the case facts; ``weight`` multiplies a case (bootstrap draws)."""
    w = F.lit(1) if weight is None else weight
    out = [F.sum(F.col(c) * w).alias(c) for c in [*COUNTERS, *PAIR_COUNTERS]]
    out += [F.sum(F.col("brier") * w).alias("brier_sum"), F.sum(F.when(F.col("brier").isNotNull(), w)).alias("probability_cases")]
    for b in range(BINS):
        gap = F.when(F.col("bin") == b, (F.col("confidence") - F.col("top_correct")) * w)
        out.append(F.coalesce(F.sum(gap), F.lit(0.0)).alias(f"bin_{b}"))
    return out


def merge_sums(weight: Column) -> list[Column]:
    """Weighted second-level sums of rows that ``counter_sums`` produced."""
    names = [*COUNTERS, *PAIR_COUNTERS, "brier_sum", "probability_cases", *[f"bin_{b}" for b in range(BINS)]]
    return [F.sum(F.col(c) * weight).alias(c) for c in names]


def metric_values() -> dict[str, Column]:
    """All metrics as expressions over the summed counters."""
    c = F.col
    out = {name: ratio(c(a), c(b)) for name, (a, b) in RATIOS.items()}
    full = c("probability_cases") == c("cases")
    brier = F.when(full, F.try_divide(c("brier_sum"), c("cases").cast("double")))
    out["brier"] = brier
    out["CA"] = 1 - brier / 2
    out["ECE10"] = F.when(full, F.try_divide(reduce(lambda a, b: a + b, [F.abs(c(f"bin_{b}")) for b in range(BINS)]),
                                             c("cases").cast("double")))
    out["duplicate_pair_f1"] = F.try_divide(
        2.0 * c("duplicate_tp"), (2 * c("duplicate_tp") + c("duplicate_fp") + c("duplicate_fn")).cast("double"))
    score = reduce(lambda a, b: a * b, [F.pow(out[k], F.lit(w)) for k, w in WEIGHTS.items()])
    out["score"] = 100 * score * F.pow(1 - out["HFAR"], F.lit(2))
    return out


def metrics(facts: DataFrame) -> DataFrame:
    """One row with every metric."""
    return facts.agg(*counter_sums()).select(*[v.alias(k) for k, v in metric_values().items()])


def metric_rows(wide: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Metric table turned to (metric, value) rows."""
    keep = keep or []
    names = [c for c in wide.columns if c not in keep]
    return wide.unpivot(keep, names, "metric", "value")


def confusion(cases: DataFrame) -> DataFrame:
    """4 x 4 counts with zero cells present for every truth that occurs."""
    return cases.groupBy("truth").agg(*[F.count_if(F.col("decision") == l).alias(l) for l in LABELS])


def paired(baseline: DataFrame, candidate: DataFrame, key: str, value: str) -> DataFrame:
    """Two arms on the same cases with the difference of one value."""
    a = baseline.select(key, F.col(value).alias("baseline"))
    b = candidate.select(key, F.col(value).alias("candidate"))
    return a.join(b, key).withColumn("delta", F.col("candidate") - F.col("baseline"))
