"""State folds: gap lifecycle, progress, budgets, feedback and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .admission import reason_codes
from .skew import lagged, running_sums, top_k

KEY = ["target_id", "gap_id"]


def sequence_numbers(rows: DataFrame, keys: list[str], bucket: str, order: list[Column]) -> DataFrame:
    """Dense sequence number per key, counted bucket by bucket."""
    return running_sums(rows, keys, bucket, order, {"sequence": F.lit(1)})


def round_limits(arrivals: DataFrame, max_rounds: int, max_documents: int) -> DataFrame:
    """How many rows each round may examine when the budget is spread over the rounds left.

    ``arrivals(claim_id, round, available)``.  A round takes at most
    ``ceil(remaining / rounds_left)`` rows, at least one.  The plan of a claim
    is a fold over its ``max_rounds`` counts (a small fixed number), so it runs
    on one row per claim.
    """
    counts = arrivals.groupBy("claim_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("round") == r, F.col("available"))), F.lit(0)).alias(f"_a{r}") for r in range(1, max_rounds + 1)])
    # Each used count becomes a real column so the expression does not nest.
    rows = counts.withColumn("_u0", F.lit(0).cast("long"))
    for r in range(1, max_rounds + 1):
        left = F.lit(max_documents) - F.col(f"_u{r - 1}")
        rounds_left = max_rounds - r + 1
        rows = rows.withColumn(f"_l{r}", F.when(left > 0, F.greatest(F.lit(1), F.ceil(left / rounds_left))).otherwise(0).cast("long"))
        rows = rows.withColumn(f"_t{r}", F.least(F.col(f"_l{r}"), F.col(f"_a{r}")).cast("long"))
        rows = rows.withColumn(f"_u{r}", (F.col(f"_u{r - 1}") + F.col(f"_t{r}")).cast("long"))
    plan = F.array(*[F.struct(F.lit(r).alias("round"), F.col(f"_l{r}").alias("limit"), F.col(f"_t{r}").alias("examined"),
                              F.col(f"_u{r}").alias("examined_total")) for r in range(1, max_rounds + 1)])
    return rows.select("claim_id", F.explode(plan).alias("p")).select("claim_id", "p.*")


def examined_rows(evidence: DataFrame, limits: DataFrame, order: list[Column], max_documents: int) -> DataFrame:
    """Rows inside their round's limit, by arrival order.

    No round can examine more than the whole budget, so each map task first
    keeps only that many rows per round.
    """
    ranked = top_k(evidence, ["claim_id", "round"], order, max_documents, "position")
    return ranked.join(limits.select("claim_id", "round", "limit"), ["claim_id", "round"]).filter("position <= limit")


def latest_per_gap(feedback: DataFrame, order: Column, *fields: str) -> DataFrame:
    """Latest feedback row of each gap as one partial aggregate."""
    return feedback.groupBy(*KEY).agg(F.max_by(F.struct(*fields), order).alias("_f")).select(*KEY, "_f.*")


def gap_state(events: DataFrame) -> DataFrame:
    """Current state per gap from open and close events.

    The latest explicit event wins: a gap is open when its last open epoch is
    later than its last close, and only closes after the last open count.
    """
    opens, closes = F.col("op") == "open", F.col("op") == "close"
    last = events.groupBy(*KEY).agg(
        F.coalesce(F.max(F.when(opens, F.col("epoch"))), F.lit(-1)).alias("last_open"),
        F.coalesce(F.max(F.when(closes, F.col("epoch"))), F.lit(-1)).alias("last_close"),
        F.max_by(F.when(opens, F.col("owner")), F.when(opens, F.col("epoch"))).alias("open_owner"))
    return last.withColumn("state", F.when(F.col("last_open") > F.col("last_close"), "open").otherwise("closed"))


def live_closures(events: DataFrame, state: DataFrame) -> DataFrame:
    """Close events after the last open, of gaps that are closed now."""
    closed = state.filter("state = 'closed'").select(*KEY, "last_open")
    return events.filter("op = 'close'").join(closed, KEY).filter("epoch > last_open").drop("last_open")


def combine_closures(closures: DataFrame) -> DataFrame:
    """Closures of one gap as the union of their bases and distinct sorted rationales.

    Distinct values are found first, so the arrays hold only what differs.
    """
    distinct = closures.select(*KEY, "basis", F.trim("rationale").alias("rationale")).distinct()
    return distinct.groupBy(*KEY).agg(
        F.array_sort(F.collect_set("basis")).alias("basis"),
        F.concat_ws(" | ", F.array_sort(F.collect_set("rationale"))).alias("rationale"))


def lifecycle_codes(definitions: DataFrame, bucket: str) -> DataFrame:
    """Gap ids whose identity changes or whose severity weakens under the same id."""
    per = definitions.groupBy(*KEY).agg(F.count_distinct("identity").alias("identities"))
    previous = lagged(definitions, KEY, bucket, F.col("epoch"), F.col("blocking"), "was_blocking")
    weak = previous.groupBy(*KEY).agg(F.count_if(F.col("was_blocking") & ~F.col("blocking")).alias("weakened"))
    out = per.join(weak, KEY)
    return out.withColumn("reasons", reason_codes(
        (F.col("identities") > 1, "conflicting_identity"), (F.col("weakened") > 0, "severity_weakened")))


def close_epochs(closures: DataFrame, bucket: str) -> DataFrame:
    """Effective close epoch: carried while the basis is unchanged, renewed when it changes."""
    before = lagged(closures, [*KEY, "owner"], bucket, F.col("epoch"), F.col("basis"), "previous_basis")
    marked = before.withColumn("renewed", F.coalesce(F.col("previous_basis") != F.col("basis"), F.lit(True)))
    inside = W.partitionBy(*KEY, "owner", bucket).orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    local = marked.withColumn("_local", F.max(F.when(F.col("renewed"), F.col("epoch"))).over(inside))
    tops = marked.groupBy(*KEY, "owner", bucket).agg(F.max(F.when(F.col("renewed"), F.col("epoch"))).alias("_top"))
    carried = tops.withColumn("_carry", F.max("_top").over(
        W.partitionBy(*KEY, "owner").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))).drop("_top")
    out = local.join(carried, [*KEY, "owner", bucket])
    return out.withColumn("effective_epoch", F.coalesce("_local", "_carry")).drop("_local", "_carry")


def set_fingerprints(records: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fingerprint of each key's set of records, independent of order and repeats.

    Record hashes are folded by xor and sum, so a key of any size is one
    partial aggregate and nothing is collected.
    """
    distinct = records.select(*keys, *fields).distinct()
    digest = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    part = lambda n: F.conv(F.substring(digest, n, 15), 16, 10).cast("long")
    folded = distinct.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(part(1)).alias("a"), F.bit_xor(part(16)).alias("b"), F.sum(part(31).cast("decimal(38,0)")).alias("c"))
    return folded.select(*keys, F.sha2(F.concat_ws("|", "n", "a", "b", "c"), 256).alias("fingerprint"))


def change_events(rows: DataFrame, keys: list[str], bucket: str, order: Column, value: str) -> DataFrame:
    """Rows whose value differs from the row before; the first row is a change too."""
    out = lagged(rows, keys, bucket, order, F.col(value), "previous")
    return out.filter(~F.col(value).eqNullSafe(F.col("previous")))


def progress(rounds: DataFrame, bucket: str) -> DataFrame:
    """New structure, repeated state or unchanged state per round of a trace."""
    first = rounds.groupBy("trace_id", "fingerprint").agg(F.min("round").alias("_first"))
    before = lagged(rounds, ["trace_id"], bucket, F.col("round"), F.col("fingerprint"), "previous")
    out = before.join(first, ["trace_id", "fingerprint"])
    new = F.col("round") == F.col("_first")
    return out.withColumn("progress", F.when(new, "new_structure").when(
        F.col("fingerprint").eqNullSafe(F.col("previous")), "unchanged").otherwise("repeated")).drop("_first")


def stop_reason() -> Column:
    """First matching reason for a target after a round; null means go on.

    Reads the flags complete, received, followups, retryable, has_next_round,
    all_unavailable, new_eligible, progress, documents_left and calls_left.
    """
    c = F.col
    waiting = (c("followups") > 0) | (c("retryable") > 0)
    idle = (c("new_eligible") == 0) & (c("progress") != "new_structure") & ~(c("has_next_round") & waiting)
    nothing = c("received") == 0
    return (F.when(c("complete"), "complete")
            .when(nothing & ~c("has_next_round") & (c("retryable") > 0), "retrieval_budget")
            .when(nothing & ~c("has_next_round") & (c("followups") > 0), "round_budget")
            .when(nothing & ~waiting & c("all_unavailable"), "provider_exhausted")
            .when(nothing & ~waiting, "empty_results")
            .when(idle & (c("progress") == "unchanged"), "no_new_eligible_materials")
            .when(idle, "repeated_state")
            .when(c("documents_left") <= 0, "document_budget").when(c("calls_left") <= 0, "decomposition_budget")
            .when(~c("has_next_round"), "round_budget"))


def reanalysis_audit(history: DataFrame, bucket: str) -> DataFrame:
    """Accepted revisions of a version with the previous one and the versions first seen since.

    ``history(trace_id, version_id, revision, analysis)``.  New versions are
    counted from first-appearance ranks, so no range self join is needed.
    """
    first = history.groupBy("trace_id", "version_id").agg(F.min("revision").alias("revision")).withColumn("_new", F.lit(1))
    marked = history.join(first, ["trace_id", "version_id", "revision"], "left").fillna(0, ["_new"])
    counted = running_sums(marked, ["trace_id"], bucket, [F.col("revision")], {"versions_so_far": F.col("_new")})
    out = lagged(counted, ["trace_id", "version_id"], bucket, F.col("revision"),
                 F.struct("revision", "analysis", "versions_so_far"), "previous")
    return out.filter("previous IS NOT NULL").select(
        "trace_id", "version_id", "revision", F.col("previous.revision").alias("previous_revision"),
        (F.col("versions_so_far") - F.col("previous.versions_so_far")).alias("new_versions"),
        (~F.col("analysis").eqNullSafe(F.col("previous.analysis"))).alias("changed"))


def feedback_audit(operations: DataFrame) -> DataFrame:
    """Per (trace, round, version): saved, decomposed and verified strictly in this order."""
    c = F.col
    at = lambda action: F.min(F.when(c("action") == action, c("sequence")))
    per = operations.filter(c("action").isin("snapshot_saved", "decompose_completed")).groupBy("trace_id", "round", "version_id").agg(
        at("snapshot_saved").alias("saved"), at("decompose_completed").alias("decomposed"))
    verified = operations.filter(c("action") == "verification_completed").groupBy("trace_id", "round").agg(F.min("sequence").alias("verified"))
    out = per.join(verified, ["trace_id", "round"], "left")
    return out.withColumn("in_order", F.coalesce((c("saved") < c("decomposed")) & (c("decomposed") < c("verified")), F.lit(False)))


def first_and_last(decisions: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    return decisions.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"),
                                      F.count(F.lit(1)).alias("checkpoints"))


def task_sets(issued: DataFrame, active: DataFrame, feedback: DataFrame) -> DataFrame:
    """Issued against active tasks after a round: follow-ups, retryable and terminal ones.

    Both sides carry ``signature``; a changed signature counts as a new task.
    """
    both = active.select(*KEY, F.col("signature").alias("_a")).join(
        issued.select(*KEY, F.col("signature").alias("_i")), KEY, "full_outer").join(
        feedback.select(*KEY, "status"), KEY, "left")
    same = F.coalesce(F.col("_a") == F.col("_i"), F.lit(False))
    kind = (F.when(F.col("_a").isNull(), "closed").when(~same, "followup")
            .when(F.col("status") == "budget_exhausted", "retryable").when(F.col("status") == "unavailable", "unavailable")
            .otherwise("active"))
    return both.select(*KEY, kind.alias("kind"))


def capped_lengths(docs: DataFrame, group: str, bucket: str, order: list[Column], length: str, cap: int, budget: int) -> DataFrame:
    """Prefix allocation in arrival order: each row gets what the budget still allows."""
    limited = docs.withColumn("_cap", F.least(F.col(length), F.lit(cap)))
    summed = running_sums(limited, [group], bucket, order, {"_run": F.col("_cap")})
    before = F.col("_run") - F.col("_cap")
    return summed.withColumn("allocated", F.greatest(F.lit(0), F.least(F.col("_cap"), F.lit(budget) - before))).drop("_cap", "_run")


def fair_shares(docs: DataFrame, group: str, bucket: str, order: str, length: str, cap: int, budget: int) -> DataFrame:
    """Water-filling: equal character shares per group, bounded per document and in total.

    The level is found on the histogram of capped lengths (at most ``cap + 1``
    values per group), so a group of any size costs one partial aggregate.  The
    few characters that do not divide evenly go to the first rows in order.
    """
    rows = docs.withColumn("_want", F.least(F.col(length), F.lit(cap)))
    hist = rows.groupBy(group, "_want").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(group).orderBy("_want").rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(group)
    levels = hist.withColumns({"_small": F.sum(F.col("_want") * F.col("_n")).over(upto), "_rows": F.sum("_n").over(upto),
                               "_all": F.sum("_n").over(every), "_sum": F.sum(F.col("_want") * F.col("_n")).over(every)})
    # Documents up to want w are served whole when the rest can still have w each.
    whole = F.col("_small") + (F.col("_all") - F.col("_rows")) * F.col("_want") <= budget
    served = levels.groupBy(group).agg(
        F.max("_sum").alias("_sum"), F.max("_all").alias("_all"),
        F.max_by("_small", F.when(whole, F.col("_want"))).alias("_s"), F.max_by("_rows", F.when(whole, F.col("_want"))).alias("_r"),
        F.max(F.when(whole, F.col("_want"))).alias("_top"))
    rest = F.col("_all") - F.coalesce("_r", F.lit(0))
    left = F.lit(budget) - F.coalesce("_s", F.lit(0))
    plan = served.select(group, F.coalesce("_top", F.lit(-1)).alias("_top"),
                         F.when(rest > 0, F.floor(left / rest)).otherwise(0).alias("_level"),
                         F.when(rest > 0, F.pmod(left, rest)).otherwise(0).alias("_extra"))
    joined = rows.join(plan, group).withColumn("_open", F.col("_want") > F.col("_top"))
    ranked = running_sums(joined.filter("_open"), [group], bucket, [F.col(order)], {"_rank": F.lit(1)}) \
        .filter(F.col("_rank") <= F.col("_extra")).select(group, order, F.lit(1).alias("_bonus"))
    out = joined.join(ranked, [group, order], "left")
    got = F.when(F.col("_open"), F.col("_level") + F.coalesce("_bonus", F.lit(0))).otherwise(F.col("_want"))
    return out.withColumn("allocated", got.cast("long")).drop("_want", "_top", "_level", "_extra", "_open", "_bonus")


def scope_tasks(scope: DataFrame, admitted: DataFrame, receipts: DataFrame, prior: DataFrame) -> DataFrame:
    """Missing scoped versions become fetch tasks; a task closes when its version returned under it.

    ``scope(target_id, version_id)``, ``prior(target_id, version_id, gap_id)`` are registered scope tasks.
    """
    task = F.concat_ws(":", "target_id", F.lit("missing-scope"), F.substring(F.sha2("version_id", 256), 1, 20))
    missing = scope.join(admitted.select("target_id", "version_id"), ["target_id", "version_id"], "left_anti").select(
        "target_id", "version_id", task.alias("gap_id"), F.lit("open").alias("op"))
    closed = prior.join(admitted.select("target_id", "version_id"), ["target_id", "version_id"], "left_semi").join(
        receipts.select("target_id", "gap_id", "version_id").distinct(), ["target_id", "gap_id", "version_id"], "left_semi").select(
        "target_id", "version_id", "gap_id", F.lit("close").alias("op"))
    return missing.unionByName(closed)


def attributed_feedback(returns: DataFrame, receipts: DataFrame, gaps: DataFrame) -> DataFrame:
    """Tasks a returned version answers: exact receipts first, else locator or basis matches."""
    c = F.col
    exact = returns.join(receipts, ["target_id", "version_id"]).select("target_id", "version_id", "gap_id", F.lit("exact").alias("attribution"))
    by_id = returns.join(gaps.select("target_id", "gap_id", c("locator").alias("version_id")), ["target_id", "version_id"])
    by_url = returns.join(gaps.select("target_id", "gap_id", c("locator").alias("url")), ["target_id", "url"])
    by_basis = returns.join(gaps.select("target_id", "gap_id", c("basis_version").alias("version_id")), ["target_id", "version_id"])
    cols = ["target_id", "version_id", "gap_id"]
    loose = by_id.select(*cols).unionByName(by_url.select(*cols)).unionByName(by_basis.select(*cols)).distinct() \
        .join(receipts.select("target_id", "version_id").distinct(), ["target_id", "version_id"], "left_anti") \
        .withColumn("attribution", F.lit("heuristic"))
    found = exact.unionByName(loose)
    none = returns.select("target_id", "version_id").join(found.select("target_id", "version_id").distinct(), ["target_id", "version_id"], "left_anti")
    return found.unionByName(none.select("target_id", "version_id", F.lit(None).cast("string").alias("gap_id"), F.lit("unattributed").alias("attribution")))
