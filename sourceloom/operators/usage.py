"""Call logs: token totals, arm scores, win rules, run and stage completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import ratio

TOKENS = ["input_tokens", "output_tokens"]
OPTIONAL = ["cached_input_tokens", "reasoning_output_tokens"]


def arm_tokens(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, failures, missing usage counts and token totals per arm."""
    total = F.coalesce(F.sum("input_tokens"), F.lit(0)) + F.coalesce(F.sum("output_tokens"), F.lit(0))
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("failed_calls"),
        (F.count_if(F.col("input_tokens").isNull()) + F.count_if(F.col("output_tokens").isNull())).alias("missing_usage"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), total.alias("total_tokens"),
        ratio(F.coalesce(F.sum("input_tokens"), F.lit(0)), F.count(F.lit(1))).alias("mean_input_tokens"))


def normalized_usage(usage: Column) -> Column:
    """Usage struct with flat cached and reasoning counts and a derived total.

    ``usage`` has input_tokens, output_tokens, total_tokens, cached_input_tokens,
    cache_read_input_tokens, reasoning_output_tokens, reasoning_tokens and the
    nested input_tokens_details.cached_tokens, output_tokens_details.reasoning_tokens.
    """
    return F.struct(
        usage["input_tokens"].alias("input_tokens"), usage["output_tokens"].alias("output_tokens"),
        F.coalesce(usage["cached_input_tokens"], usage["input_tokens_details"]["cached_tokens"],
                   usage["cache_read_input_tokens"]).alias("cached_input_tokens"),
        F.coalesce(usage["reasoning_output_tokens"], usage["output_tokens_details"]["reasoning_tokens"],
                   usage["reasoning_tokens"]).alias("reasoning_output_tokens"),
        F.coalesce(usage["total_tokens"], usage["input_tokens"] + usage["output_tokens"]).alias("total_tokens"))


def usage_partials(calls: DataFrame, *by: str) -> DataFrame:
    """Known sums and counts; these rows add up across any later grouping."""
    known = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0))
    cached = known & F.col("cached_input_tokens").isNotNull() & (F.col("cached_input_tokens") <= F.col("input_tokens"))
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successful_calls"),
        F.count_if(known).alias("known_usage_calls"), total("input_tokens").alias("known_input_tokens"),
        total("output_tokens").alias("known_output_tokens"),
        F.coalesce(F.sum(F.when(cached, F.col("cached_input_tokens"))), F.lit(0)).alias("known_cached_input_tokens"),
        F.count_if(cached).alias("known_cached_calls"))


def combine_usage(partials: DataFrame, *by: str) -> DataFrame:
    """Partials to totals; an exact total exists only when every call reported usage."""
    names = [c for c in partials.columns if c.startswith("known_") or c in ("attempts", "successful_calls")]
    out = partials.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])
    full = (F.col("attempts") > 0) & (F.col("known_usage_calls") == F.col("attempts"))
    return out.withColumns({
        "usage_complete": full,
        "known_total_tokens": F.col("known_input_tokens") + F.col("known_output_tokens"),
        "total_tokens": F.when(full, F.col("known_input_tokens") + F.col("known_output_tokens")),
        "cached_input_tokens": F.when((F.col("attempts") > 0) & (F.col("known_cached_calls") == F.col("attempts")),
                                      F.col("known_cached_input_tokens"))})


def resource_rollup(calls: DataFrame) -> DataFrame:
    """Totals per (arm, variant) with an all-variants row per arm."""
    out = calls.rollup("arm", "variant").agg(
        F.count(F.lit(1)).alias("model_calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.sum("wall_seconds").alias("wall_seconds"))
    return out.filter("arm IS NOT NULL").fillna("all_variants", ["variant"])


def arm_scores(results: DataFrame) -> DataFrame:
    """Per arm: accuracy, false-claim recall, abstentions, invalid rows, origin accuracy.

    ``results`` has arm, valid, verdict, truth, origin_alternatives (array of
    arrays or null), named_origins and lineage_certified.
    """
    c = F.col
    hit = c("valid") & (c("verdict") == c("truth"))
    false = c("truth") == "contradicted"
    traceable = F.size(F.coalesce(c("origin_alternatives"), F.array().cast("array<array<string>>"))) > 0
    origin_hit = c("valid") & origins_match(c("named_origins"), c("origin_alternatives"))
    out = results.groupBy("arm").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(hit).alias("correct"), F.count_if(false).alias("false_claims"),
        F.count_if(hit & false).alias("false_found"), F.count_if(c("valid") & (c("verdict") == "unresolved")).alias("abstained"),
        F.count_if(~c("valid")).alias("invalid"), F.count_if(traceable).alias("traceable"),
        F.count_if(traceable & origin_hit).alias("origin_correct"),
        F.count_if(F.coalesce(c("lineage_certified"), F.lit(False))).alias("lineage_certified"))
    return out.withColumns({
        "accuracy": ratio(c("correct"), c("cases")), "false_claim_recall": ratio(c("false_found"), c("false_claims")),
        "origin_accuracy": ratio(c("origin_correct"), c("traceable"))})


def origins_match(named: Column, alternatives: Column) -> Column:
    """The named originals equal one acceptable alternative as a set of ids."""
    mine = F.array_sort(F.coalesce(named, F.array().cast("array<string>")))
    return F.coalesce(F.exists(alternatives, lambda a: F.array_sort(a) == mine), F.lit(False))


def recall_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, true and false recall, abstention and completion rate per arm."""
    c = F.col
    good, true = c("decision") == c("truth"), c("truth") == "true"
    out = rows.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).alias("correct"), F.count_if(true).alias("true_n"),
        F.count_if(true & (c("decision") == "true")).alias("true_hit"), F.count_if(~true).alias("false_n"),
        F.count_if(~true & (c("decision") == "false")).alias("false_hit"),
        F.count_if(c("decision") == "unverifiable").alias("abstained"), F.count_if(c("status") == "completed").alias("completed"))
    return out.select("arm", ratio(c("correct"), c("n")).alias("accuracy"), ratio(c("true_hit"), c("true_n")).alias("true_recall"),
                      ratio(c("false_hit"), c("false_n")).alias("false_recall"), ratio(c("abstained"), c("n")).alias("abstention_rate"),
                      ratio(c("completed"), c("n")).alias("completion_rate"))


def balanced_accuracy(rows: DataFrame) -> DataFrame:
    """Sensitivity, specificity and their mean per arm; invalid evidence predicts nothing."""
    c = F.col
    pos, neg = c("expected") == "elevated", c("expected") == "ordinary"
    guess = F.when(c("evidence_valid"), c("predicted"))
    out = rows.groupBy("arm").agg(
        F.count_if(pos).alias("positives"), F.count_if(neg).alias("negatives"),
        F.count_if(pos & (guess == "elevated")).alias("true_positives"), F.count_if(neg & (guess == "ordinary")).alias("true_negatives"))
    return out.withColumns({"sensitivity": ratio(c("true_positives"), c("positives")), "specificity": ratio(c("true_negatives"), c("negatives"))}) \
        .withColumn("balanced_accuracy", (c("sensitivity") + c("specificity")) / 2)


def side_by_side(rows: DataFrame, arms: tuple[str, str], values: list[str]) -> DataFrame:
    """One row with both arms' values as <arm>_<value> columns."""
    return rows.agg(*[F.max(F.when(F.col("arm") == a, F.col(v))).alias(f"{a}_{v}") for a in arms for v in values])


def winner(left: Column, right: Column, left_name: str, right_name: str) -> Column:
    return F.when(left > right, left_name).when(left < right, right_name).otherwise("tie")


def win_rule(arms: DataFrame, max_token_ratio: float) -> DataFrame:
    """Harness wins on strictly higher accuracy, all outputs valid and a bounded token ratio."""
    wide = side_by_side(arms, ("direct", "harness"), ["accuracy", "invalid", "total_tokens"])
    share = F.try_divide(F.col("harness_total_tokens").cast("double"), F.col("direct_total_tokens").cast("double"))
    flags = {"accuracy_strictly_higher": F.coalesce("harness_accuracy", F.lit(0.0)) > F.coalesce("direct_accuracy", F.lit(0.0)),
             "all_outputs_valid": F.col("harness_invalid") == 0,
             "within_token_ratio": F.coalesce(share <= max_token_ratio, F.lit(False))}
    out = wide.select(*[v.alias(k) for k, v in flags.items()], share.alias("token_ratio"))
    return out.withColumn("harness_wins", F.col("accuracy_strictly_higher") & F.col("all_outputs_valid") & F.col("within_token_ratio"))


def efficiency_met(arms: DataFrame, planned: Column, limit: float = 0.8) -> DataFrame:
    """Every planned case right in both arms, usage complete and at most ``limit`` of the direct tokens."""
    wide = side_by_side(arms.withColumn("complete", F.col("usage_complete").cast("int")),
                        ("direct", "harness"), ["cases", "matches", "total_tokens", "complete"])
    c = F.col
    all_right = (c("direct_cases") == planned) & (c("harness_cases") == planned) & (c("direct_matches") == planned) & (c("harness_matches") == planned)
    known = (c("direct_complete") == 1) & (c("harness_complete") == 1) & (c("direct_total_tokens") > 0)
    cheap = c("harness_total_tokens") <= limit * c("direct_total_tokens")
    return wide.withColumn("met", F.coalesce(all_right & known & cheap, F.lit(False)))


def packet_tokens(chars: Column, output_tokens: Column) -> Column:
    """Estimate of what a run itself sent: a quarter of the characters, half to even, plus output."""
    return F.bround(chars / F.lit(4.0), 0).cast("long") + output_tokens


def run_completion(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Shape, errors, call success, verdict agreement and clock gap of each run.

    ``runs`` has run_id, shape_valid, errors, verdict, visible_verdict, timer_seconds, utc_seconds.
    """
    c = F.col
    per = calls.groupBy("run_id").agg(F.bool_and("success").alias("_all"), F.count(F.lit(1)).alias("calls"))
    out = runs.join(per, "run_id", "left").fillna(0, ["calls"])
    done = c("shape_valid") & (c("calls") > 0) & F.coalesce(c("_all"), F.lit(False)) & (c("errors") == 0) & (c("verdict") == c("visible_verdict"))
    gap = c("timer_seconds").isNull() | c("utc_seconds").isNull() | (F.abs(c("timer_seconds") - c("utc_seconds")) > 1)
    return out.withColumns({"completed": F.coalesce(done, F.lit(False)), "clock_discrepancy": gap}).drop("_all")


def stage_completion(phases: DataFrame, calls: DataFrame, required: list[str], omitted: list[str]) -> DataFrame:
    """Required stages completed and attempted; omitted stages skipped exactly once and never called."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    p = phases.filter(F.col("stage").isin(required + omitted)).groupBy("run_id").agg(
        F.collect_set(F.when(F.col("status") == "completed", F.col("stage"))).alias("done"),
        F.count_if(F.col("stage").isin(omitted)).alias("omitted_rows"),
        F.count_if(F.col("stage").isin(omitted) & (F.col("status") == "skipped")).alias("skipped_rows"),
        F.count_distinct(F.when(F.col("stage").isin(omitted), F.col("stage"))).alias("omitted_stages"))
    failed = phases.groupBy("run_id").agg(F.count_if(F.col("status") == "failed").alias("failed"))
    k = calls.filter(F.col("stage").isin(required + omitted)).groupBy("run_id").agg(
        F.collect_set(F.when(F.col("success"), F.col("stage"))).alias("tried"),
        F.count_if(F.col("stage").isin(omitted)).alias("omitted_calls"))
    out = failed.join(p, "run_id", "left").join(k, "run_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = F.array_intersect(none("done"), none("tried"))
    skipped = ((zero("omitted_rows") == len(omitted)) & (zero("skipped_rows") == len(omitted))
               & (zero("omitted_stages") == len(omitted)) & (zero("omitted_calls") == 0))
    return out.select("run_id", F.array_join(F.array_sort(F.array_except(lit(required), both)), ",").alias("missing_stages"),
                      ((F.size(F.array_except(lit(required), both)) == 0) & skipped & (F.col("failed") == 0)).alias("complete"))


def reconcile(recomputed: DataFrame, stored: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows where a stored total differs from the recomputed one, or exists on one side only."""
    a = recomputed.select(*keys, F.struct(*values).alias("_a"))
    b = stored.select(*keys, F.struct(*values).alias("_b"))
    rows = a.join(b, keys, "full_outer")
    where = (F.when(F.col("_a").isNull(), "stored_only").when(F.col("_b").isNull(), "recomputed_only")
             .when(~F.col("_a").eqNullSafe(F.col("_b")), "differs"))
    bad = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"_a.{v}").eqNullSafe(F.col(f"_b.{v}")), F.lit(v)) for v in values])), ",")
    return rows.select(*keys, where.alias("problem"), bad.alias("fields")).filter("problem IS NOT NULL")


def single_model(calls: DataFrame) -> DataFrame:
    """Each arm used one actual model and all arms used the same one."""
    per = calls.filter("actual_model IS NOT NULL").groupBy("arm").agg(
        F.count_distinct("actual_model").alias("models"), F.min("actual_model").alias("model"))
    return per.agg(F.count(F.lit(1)).alias("arms"), F.max("models").alias("most_models"), F.count_distinct("model").alias("distinct_models")) \
        .withColumn("consistent", (F.col("most_models") == 1) & (F.col("distinct_models") == 1))


def shared_responses(calls: DataFrame) -> DataFrame:
    """Response ids that occur in more than one arm."""
    return calls.groupBy("response_id").agg(F.count_distinct("arm").alias("arms")).filter("arms > 1")


def outcome_flags() -> dict[str, Column]:
    """Row outcome flags from valid, observed, cutoff_expected, future_expected and role."""
    c = F.col
    claim = c("role") == "authenticity"
    return {
        "cutoff_match": c("valid") & (c("observed") == c("cutoff_expected")),
        "future_match": c("valid") & (c("observed") == c("future_expected")),
        "abstained": c("valid") & (c("observed") == "unresolved"),
        "accepted_later_false": c("valid") & claim & (c("observed") == "supported"),
        "called_later_false": c("valid") & claim & (c("observed") == "contradicted"),
        "unwarranted_settled": c("valid") & (c("cutoff_expected") == "unresolved") & (c("observed") != "unresolved")}


def outcome_counts(rows: DataFrame) -> DataFrame:
    """Outcome counts per (variant, arm) split by role."""
    flagged = rows.withColumns(outcome_flags())
    claim, control = F.col("role") == "authenticity", F.col("role") == "attribution_control"
    return flagged.groupBy("variant", "arm").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("valid").alias("valid"), F.count_if("cutoff_match").alias("cutoff_matches"),
        F.count_if(claim).alias("claims"), F.count_if(claim & F.col("abstained")).alias("claim_abstentions"),
        F.count_if("accepted_later_false").alias("claims_accepted"), F.count_if("called_later_false").alias("claims_called_false"),
        F.count_if("unwarranted_settled").alias("unwarranted_settled"),
        F.count_if(control).alias("controls"), F.count_if(control & F.col("cutoff_match")).alias("control_matches"))


def screening(rows: DataFrame, direct_tokens: Column, tokens: Column, min_correct: float = 0.75, max_ratio: float = 2.0) -> DataFrame:
    """Strict fact accuracy, later-false detections, control flags and the goal booleans."""
    c = F.col
    later = c("future_expected") == "contradicted"
    high = c("valid") & (c("fraud_risk") == "high")
    out = rows.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(c("valid") & (c("observed") == c("cutoff_expected"))).alias("strict_correct"),
        F.count_if(later).alias("later_false"), F.count_if(later & high).alias("detected"), F.count_if(~later & high).alias("control_flags"),
        F.sum(tokens).alias("tokens"), F.sum(direct_tokens).alias("direct_tokens"))
    share = F.try_divide(c("tokens").cast("double"), c("direct_tokens").cast("double"))
    return out.withColumns({
        "token_ratio": share, "accuracy_goal": c("strict_correct") >= min_correct * c("cases"),
        "detection_goal": (c("detected") == c("later_false")) & (c("later_false") > 0),
        "token_goal": F.coalesce(share <= max_ratio, F.lit(False))})


def normalized_arm(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """Every expected case kept: a missing or invalid row becomes an error that is unverifiable."""
    from .admission import LABELS
    c = F.col
    out = expected.join(rows, "case_id", "left")
    declared = F.coalesce(c("status") == "completed", F.lit(False))
    valid = declared & F.coalesce(c("decision").isin(LABELS) & c("assessment_valid"), F.lit(False))
    error = F.when(valid, F.lit(None).cast("string")).when(declared, "InvalidPrediction").otherwise(
        F.coalesce(c("error_type"), F.lit("MissingArmResult")))
    return out.select("case_id", F.when(valid, "completed").otherwise("error").alias("status"),
                      F.when(valid, c("decision")).otherwise("unverifiable").alias("decision"), error.alias("error_type"))


def raw_row_codes(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Contract of raw rows: exact (case, variant) coverage and status against error."""
    from .admission import reason_codes
    c = F.col
    per = rows.groupBy("case_id", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~c("status").isin("completed", "error")).alias("bad_status"),
        F.count_if((c("status") == "error") & c("error_type").isNull()).alias("no_error"),
        F.count_if((c("status") == "completed") & c("error_type").isNotNull()).alias("stray_error"))
    both = per.join(expected.select("case_id", "variant").withColumn("_e", F.lit(True)), ["case_id", "variant"], "full_outer")
    return both.select("case_id", "variant", reason_codes(
        (c("n").isNull(), "missing_row"), (c("_e").isNull(), "unexpected_row"), (c("n") > 1, "duplicate_row"),
        (c("bad_status") > 0, "invalid_status"), (c("no_error") > 0, "error_without_type"),
        (c("stray_error") > 0, "completed_with_error")).alias("reasons")).filter(F.size("reasons") > 0)


def control_diagnosis(expected: Column, loop: Column, control: Column, control_status: Column) -> Column:
    """Why a case failed, judged with a run that had all the evidence."""
    return (F.when(control_status != "completed", "control_error")
            .when(control != expected, "semantic_failure_with_full_evidence")
            .when(loop != expected, "loop_or_evidence_access_failure")
            .otherwise("loop_and_full_evidence_agree_with_gold"))


def batch_status(items: DataFrame) -> DataFrame:
    """Items, claims and located claims by final status."""
    return items.agg(
        F.count(F.lit(1)).alias("items"), F.sum("claims").alias("claims"), F.sum("located").alias("located"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "partial", "failed")])
