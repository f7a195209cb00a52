"""Paired event-cluster bootstrap from per-event counter sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .scoring import LOWER_IS_BETTER, counter_sums, merge_sums, metric_rows, metric_values


def quantile(values: Column, q: float | list[float]) -> Column:
    """Exact quantile with linear interpolation between order statistics."""
    return F.percentile(values, q)


def _slot(seed: int) -> Column:
    """Uniform 60-bit number of (seed, draw, slot), reproducible in any engine with md5."""
    text = F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def multiplicities(events: DataFrame, draws: int, seed: int) -> DataFrame:
    """How often each event is drawn: ``draws`` samples of as many events with replacement.

    Event numbers come from ranks inside hash buckets of the distinct ids, and
    every draw generates its slots next to the event's number, so the sample
    table grows as draws x events and is never collected.
    """
    indexed = _numbered(events)
    slots = indexed.withColumnRenamed("event_no", "slot").drop("event_id").withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picked = slots.withColumn("event_no", F.pmod(_slot(seed), F.col("n")))
    counted = picked.groupBy("draw", "event_no").agg(F.count(F.lit(1)).alias("times"))
    return counted.join(indexed.select("event_id", "event_no"), "event_no").select("draw", "event_id", "times")


def _numbered(events: DataFrame) -> DataFrame:
    """Distinct events with a dense number in hash order and the total, without one global sort task."""
    ids = events.select("event_id").distinct().withColumn("_b", F.substring(F.md5("event_id"), 1, 3))
    sizes = ids.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.withColumns({  # at most 4096 rows
        "_base": F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "n": F.sum("_n").over(W.partitionBy())}).drop("_n")
    inside = F.row_number().over(W.partitionBy("_b").orderBy(F.md5("event_id"), "event_id")) - 1
    return ids.withColumn("_i", inside).join(F.broadcast(base), "_b").select(
        "event_id", (F.col("_base") + F.col("_i")).alias("event_no"), "n")


def event_bootstrap(baseline: DataFrame, candidate: DataFrame, draws: int = 500, seed: int = 0) -> DataFrame:
    """Metric differences with event-cluster percentile intervals.

    ``baseline`` and ``candidate`` are case facts.  Each arm is reduced to one
    row per event first; a draw then only reweights those rows.  One undefined
    draw suppresses the metric's interval, the valid-draw count stays.
    """
    arms = baseline.withColumn("arm", F.lit("a")).unionByName(candidate.withColumn("arm", F.lit("b")))
    per_event = cut(arms.groupBy("arm", "event_id").agg(*counter_sums()))
    values = metric_values()
    overall = per_event.groupBy("arm").agg(*merge_sums(F.lit(1))).select("arm", *[v.alias(k) for k, v in values.items()])
    observed = metric_rows(overall, ["arm"]).groupBy("metric").agg(
        F.max(F.when(F.col("arm") == "a", F.col("value"))).alias("baseline"),
        F.max(F.when(F.col("arm") == "b", F.col("value"))).alias("candidate"))
    weights = multiplicities(per_event, draws, seed)
    drawn = per_event.join(weights, "event_id").groupBy("arm", "draw").agg(*merge_sums(F.col("times")))
    rows = metric_rows(drawn.select("arm", "draw", *[v.alias(k) for k, v in values.items()]), ["arm", "draw"])
    deltas = rows.groupBy("metric", "draw").agg(
        (F.max(F.when(F.col("arm") == "b", F.col("value"))) - F.max(F.when(F.col("arm") == "a", F.col("value")))).alias("delta"))
    spread = deltas.groupBy("metric").agg(F.count("delta").alias("valid_draws"), quantile(F.col("delta"), [.025, .975]).alias("q"))
    several = per_event.agg(F.count_distinct("event_id").alias("events"))
    out = observed.join(spread, "metric").join(F.broadcast(several))
    full = (F.col("valid_draws") == draws) & (F.col("events") > 1)
    return out.select(
        "metric", "baseline", "candidate", (F.col("candidate") - F.col("baseline")).alias("delta"),
        F.when(full, F.col("q")[0]).alias("low"), F.when(full, F.col("q")[1]).alias("high"),
        F.when(F.col("events") > 1, F.col("valid_draws")).otherwise(F.lit(0)).alias("valid_draws"),
        F.when(full, "computed").otherwise("insufficient_events_or_undefined_resample_metrics").alias("interval_status"),
        F.when(F.col("metric").isin(LOWER_IS_BETTER), "lower").otherwise("higher").alias("preferred_direction"))
