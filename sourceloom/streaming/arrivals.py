"""Arriving versions and gap events as Structured Streaming jobs.

State is kept by the built-in streaming aggregate or as tables that
``foreachBatch`` extends; each job has a batch twin with the same answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.admission import with_eligibility
from ..operators.skew import split_lookup
from ..session import cut


def _before(spark, path: str, schema: str, batch_id: int) -> DataFrame:
    """Rows that earlier batches wrote to a table partitioned by batch: one scan, however many batches there were."""
    empty = spark.createDataFrame([], f"{schema}, n int")
    rows = spark.read.schema(empty.schema).option("basePath", path).parquet(path) if batch_id else empty
    return rows.filter(F.col("n") < batch_id).drop("n")


def classified_batches(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` job: first, duplicate or collision for every arriving version.

    ``arrivals(version_id, fingerprint, position)``.  The first fingerprint of
    each id is kept as a table that every batch extends by the ids it sees
    first.  A batch is classified by joins that split hot ids, so a mass of
    copies never meets in one task; a replayed batch overwrites its own folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = _before(spark, f"{path}/first", "version_id string, fingerprint string, at long", batch_id)
        own = batch.groupBy("version_id").agg(F.min_by("fingerprint", "position").alias("fingerprint"), F.min("position").alias("at"),
                                              F.count(F.lit(1)).alias("rows"))
        known = cut(own.join(seen.select("version_id", F.col("fingerprint").alias("_old"), F.col("at").alias("_at")), "version_id", "left"))
        known.filter("_at IS NULL").select("version_id", "fingerprint", "at").write.mode("overwrite").parquet(f"{path}/first/n={batch_id}")
        first = known.select("version_id", "rows", F.coalesce("_old", "fingerprint").alias("_fp"), F.coalesce("_at", "at").alias("at"))
        kind = F.when(F.col("position") == F.col("at"), "first").when(F.col("fingerprint") == F.col("_fp"), "duplicate").otherwise("collision")
        out = split_lookup(batch, first, ["version_id"], "rows").withColumn("arrival", kind)
        out.select("version_id", "position", "arrival").write.mode("overwrite").parquet(f"{path}/arrivals/n={batch_id}")
    return write


def route_late(arrivals: DataFrame) -> DataFrame:
    """Late data rule: a version available after its target's cutoff goes to the archive, never away."""
    rows = with_eligibility(arrivals)
    return rows.withColumn("sink", F.when(F.size("reasons") == 0, "graph").otherwise("archive"))


def gap_ledger_stream(events: DataFrame) -> DataFrame:
    """Current state per gap; later rows replace earlier ones (update mode).

    Epochs decide, not arrival, so late and duplicate events change nothing.
    The fold is two maxima, which the built-in streaming aggregate keeps as
    keyed state with map-side combine; no Python runs per gap.
    """
    at = lambda op: F.coalesce(F.max(F.when(F.col("op") == op, F.col("epoch"))), F.lit(-1))
    last = events.groupBy("target_id", "gap_id").agg(at("open").alias("last_open"), at("close").alias("last_close"))
    return last.withColumn("state", F.when(F.col("last_open") > F.col("last_close"), "open").otherwise("closed"))


def gated_batches(path: str, block: int = 10_000) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` job: verify a round only when its input fingerprint changed since the last one.

    ``rounds(target_id, round, fingerprint)``.  Inside a batch the previous
    fingerprint comes from windows over blocks of rounds; the first round of a
    target compares with the last fingerprint that the batch before left, one
    row per target.  A replayed batch reads the same state and overwrites its own.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = "target_id string, round long, fingerprint string"
        empty = spark.createDataFrame([], state)
        last = spark.read.schema(empty.schema).parquet(f"{path}/last/{batch_id - 1}") if batch_id else empty
        rows = batch.select("target_id", "round", "fingerprint")
        marked = last.withColumn("old", F.lit(True)).unionByName(rows.withColumn("old", F.lit(False))).withColumn("block", F.floor(F.col("round") / block))
        flagged = input_gate(marked, "block").filter("NOT old")
        flagged.select("target_id", "round", "fingerprint", "verified").write.mode("overwrite").parquet(f"{path}/rounds/n={batch_id}")
        last.unionByName(rows).groupBy("target_id").agg(F.max("round").alias("round"), F.max_by("fingerprint", "round").alias("fingerprint")) \
            .write.mode("overwrite").parquet(f"{path}/last/{batch_id}")
    return write


def input_gate(rounds: DataFrame, bucket: str) -> DataFrame:
    """Batch twin of the input gate."""
    from ..operators.skew import lagged
    out = lagged(rounds, ["target_id"], bucket, F.col("round"), F.col("fingerprint"), "previous")
    return out.withColumn("verified", ~F.col("fingerprint").eqNullSafe(F.col("previous")))


def deferred(received, has_next_round, documents_left, calls_left, blocking_provenance_gaps):
    """Put off verification while a provenance gap blocks and retrieval can still act on it."""
    return (blocking_provenance_gaps > 0) & (received > 0) & has_next_round & (documents_left > 0) & (calls_left > 0)


def budget_counters(rounds: DataFrame, bucket: str, max_documents: int, max_calls: int) -> DataFrame:
    """Running rounds, documents and decomposition calls per target, with overflow flags."""
    from ..operators.skew import running_sums
    out = running_sums(rounds, ["target_id"], bucket, [F.col("round")],
                       {"rounds_used": F.lit(1), "documents_used": F.col("documents"), "calls_used": F.col("calls")})
    return out.withColumn("over_budget", (F.col("documents_used") > max_documents) | (F.col("calls_used") > max_calls))


def unprocessed(arrivals: DataFrame, ledger: DataFrame) -> DataFrame:
    """Versions to decompose: first arrival of a version that the processed ledger does not hold."""
    fresh = arrivals.join(ledger.select("version_id").distinct(), "version_id", "left_anti")
    return fresh.groupBy("version_id").agg(F.min("position").alias("position"))


def processed_ledger(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that extends a table of processed versions once per batch.

    A replayed batch overwrites its own folder, so a restart adds nothing twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        known = _before(batch.sparkSession, path, "version_id string", batch_id)
        unprocessed(batch, known).write.mode("overwrite").parquet(f"{path}/n={batch_id}")
    return write
