"""Arm scores, token accounting, completion and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from . import derive as D
from .registry import query

_TOK = """CAST(count(*) AS BIGINT) AS calls, count(*) FILTER (NOT success) AS failed_calls,
  count(*) FILTER (input_tokens IS NULL) + count(*) FILTER (output_tokens IS NULL) AS missing_usage,
  CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(input_tokens), 0) + coalesce(sum(output_tokens), 0) AS BIGINT) AS total_tokens,
  round(coalesce(sum(input_tokens), 0) / count(*), 6) AS mean_input_tokens"""


@query("A19", D.with_ctes(D.CALLS_SQL, body=f"SELECT arm, {_TOK} FROM calls GROUP BY arm"))
def usage_totals(t):
    """Token totals per arm with missing-usage counts."""
    return U.arm_tokens(D.calls(t), "arm").withColumn("mean_input_tokens", F.round("mean_input_tokens", 6))


@query("A22", D.with_ctes(D.CALLS_SQL, body=f"SELECT arm, stage, {_TOK} FROM calls GROUP BY arm, stage"))
def stage_tokens(t):
    """Token totals per arm and stage."""
    return U.arm_tokens(D.calls(t), "arm", "stage").withColumn("mean_input_tokens", F.round("mean_input_tokens", 6))


_KNOWN = "(input_tokens IS NOT NULL AND output_tokens IS NOT NULL)"


@query("A20 A21", D.with_ctes(D.CALLS_SQL, body=f"""
SELECT arm, variant, count(*) AS attempts, count(*) FILTER ({_KNOWN}) = count(*) AS usage_complete,
  count(*) FILTER ({_KNOWN}) AS known_usage_calls, CAST(coalesce(sum(input_tokens + output_tokens) FILTER ({_KNOWN}), 0) AS BIGINT) AS known_total_tokens,
  CASE WHEN count(*) FILTER ({_KNOWN}) = count(*) THEN CAST(sum(input_tokens + output_tokens) AS BIGINT) END AS total_tokens,
  CAST(coalesce(sum(cached_input_tokens) FILTER ({_KNOWN}), 0) AS BIGINT) AS known_cached_input_tokens
FROM calls GROUP BY arm, variant"""))
def usage_completeness(t):
    """Completeness-aware totals: per-case partials combined per arm and variant."""
    partial = U.usage_partials(D.calls(t), "arm", "variant", "case_id")
    return U.combine_usage(partial, "arm", "variant").select(
        "arm", "variant", "attempts", "usage_complete", "known_usage_calls", "known_total_tokens", "total_tokens", "known_cached_input_tokens")


@query("A20 A21", D.with_ctes(D.CALLS_SQL, body=f"""
SELECT case_id, arm, count(*) AS attempts, count(*) FILTER ({_KNOWN}) = count(*) AS usage_complete,
  CASE WHEN count(*) FILTER ({_KNOWN}) = count(*) THEN CAST(sum(input_tokens + output_tokens) AS BIGINT) END AS total_tokens
FROM calls GROUP BY case_id, arm"""))
def case_usage(t):
    """Exact totals per case and arm where every call reported usage, from daily partials."""
    partial = U.usage_partials(D.calls(t).withColumn("chunk", F.floor(F.col("sequence") / 1000)), "case_id", "arm", "chunk")
    return U.combine_usage(partial, "case_id", "arm").select("case_id", "arm", "attempts", "usage_complete", "total_tokens")


@query("A23", D.with_ctes(D.CALLS_SQL, body="""
SELECT arm, coalesce(variant, 'all_variants') AS variant, count(*) AS model_calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, round(sum(wall_seconds), 4) AS wall_seconds
FROM calls GROUP BY ROLLUP (arm, variant) HAVING arm IS NOT NULL"""))
def usage_rollup(t):
    """Totals per arm and variant plus an all-variants row."""
    return U.resource_rollup(D.calls(t)).withColumn("wall_seconds", F.round("wall_seconds", 4))


_RESULTS = D.CASES_SQL + """, results AS (
  SELECT id, CASE WHEN j = 0 THEN 'direct' ELSE 'harness' END AS arm, (id + j) % 9 <> 0 AS valid,
    ['supported','contradicted','conflicting','unresolved'][CASE truth WHEN 'true' THEN 1 WHEN 'false' THEN 2 WHEN 'disputed' THEN 3 ELSE 4 END] AS truth,
    ['supported','contradicted','conflicting','unresolved'][CASE WHEN j = 1 AND id % 2 = 0 THEN CASE truth WHEN 'true' THEN 1 WHEN 'false' THEN 2 WHEN 'disputed' THEN 3 ELSE 4 END
      ELSE CASE decision WHEN 'true' THEN 1 WHEN 'false' THEN 2 WHEN 'disputed' THEN 3 ELSE 4 END END] AS verdict,
    traceable, CASE WHEN j = 0 THEN roots ELSE [root] END AS named, root, j = 1 AND id % 5 = 0 AS lineage_certified
  FROM cases, (VALUES (0), (1)) v(j))"""


def _results(t):
    """Two arms over the labelled documents; the harness arm is right more often."""
    rows = D.cases(t).withColumn("arm", F.explode(F.array(F.lit("direct"), F.lit("harness"))))
    harness, i = F.col("arm") == "harness", F.col("id")
    verdict = lambda c: F.when(c == "true", "supported").when(c == "false", "contradicted").when(c == "disputed", "conflicting").otherwise("unresolved")
    return rows.select(
        "id", "arm", ((i + harness.cast("int")) % 9 != 0).alias("valid"), verdict(F.col("truth")).alias("truth"),
        F.when(harness & (i % 2 == 0), verdict(F.col("truth"))).otherwise(verdict(F.col("decision"))).alias("verdict"),
        F.col("acceptable_roots").alias("origin_alternatives"),
        F.when(harness, F.array(F.concat(F.lit("root"), (i % 50).cast("string")))).otherwise(F.col("roots")).alias("named_origins"),
        (harness & (i % 5 == 0)).alias("lineage_certified"), "event_id")


_SCORES = _RESULTS + """, scores AS (
SELECT arm, count(*) AS cases, count(*) FILTER (valid AND verdict = truth) AS correct, count(*) FILTER (truth = 'contradicted') AS false_claims,
  count(*) FILTER (valid AND verdict = truth AND truth = 'contradicted') AS false_found, count(*) FILTER (valid AND verdict = 'unresolved') AS abstained,
  count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (traceable) AS traceable,
  count(*) FILTER (traceable AND valid AND (list_sort(named) = [root] OR list_sort(named) = list_sort([root, 'root_shared']))) AS origin_correct,
  count(*) FILTER (lineage_certified) AS lineage_certified FROM results GROUP BY arm)"""


@query("A16 A37", D.with_ctes(_SCORES, body="""
SELECT *, round(correct / cases, 9) AS accuracy, round(false_found / nullif(false_claims, 0), 9) AS false_claim_recall,
  round(origin_correct / nullif(traceable, 0), 9) AS origin_accuracy FROM scores"""))
def arm_scores(t):
    """Accuracy, false-claim recall, abstention, invalid outputs and origin accuracy per arm."""
    return U.arm_scores(_results(t)).withColumns({c: F.round(c, 9) for c in ("accuracy", "false_claim_recall", "origin_accuracy")})


@query("A25 A26 X30", D.with_ctes(_SCORES, D.CALLS_SQL, body="""
, tk AS (SELECT arm, sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0))::BIGINT AS total FROM calls GROUP BY arm),
a AS (SELECT s.*, tk.total FROM scores s JOIN tk ON tk.arm = s.arm)
SELECT h.correct / h.cases > d.correct / d.cases AS accuracy_strictly_higher, h.invalid = 0 AS all_outputs_valid,
  h.total / d.total::DOUBLE <= 1.5 AS within_token_ratio, round(h.total / d.total::DOUBLE, 9) AS token_ratio,
  (h.correct / h.cases > d.correct / d.cases AND h.invalid = 0 AND h.total / d.total::DOUBLE <= 1.5) AS harness_wins
FROM a d, a h WHERE d.arm = 'direct' AND h.arm = 'harness'""".replace("\n, tk", ", tk", 1)))
def win_rule(t):
    """Registered rule: higher accuracy, all outputs valid, tokens within the ratio."""
    tokens = U.arm_tokens(D.calls(t), "arm").select("arm", "total_tokens")
    return U.win_rule(U.arm_scores(_results(t)).join(tokens, "arm"), 1.5).withColumn("token_ratio", F.round("token_ratio", 9))


@query("X30", """
WITH c AS (SELECT conv_id, coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS packet_chars,
  coalesce(sum(len(regexp_extract_all(text, '[^ ]+'))) FILTER (role = 'assistant'), 0)::BIGINT AS output_tokens FROM conversations GROUP BY conv_id)
SELECT *, round_even(packet_chars / 4.0, 0)::BIGINT + output_tokens AS packet_tokens, round(output_tokens / nullif(packet_chars, 0), 9) AS output_ratio FROM c""")
def packet_token_estimate(t):
    """Estimate of the tokens each conversation sent by itself: a quarter of the characters asked plus the words answered."""
    said = lambda role, n: F.coalesce(F.sum(F.when(F.col("role") == role, n)), F.lit(0)).cast("long")
    words = F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), 0))
    per = t("conversations").groupBy("conv_id").agg(said("user", F.length("text")).alias("packet_chars"), said("assistant", words).alias("output_tokens"))
    return per.select("*", U.packet_tokens(F.col("packet_chars"), F.col("output_tokens")).alias("packet_tokens"),
                      F.round(F.try_divide("output_tokens", "packet_chars"), 9).alias("output_ratio"))


@query("A26", D.with_ctes(_RESULTS, D.CALLS_SQL, body=f"""
, a AS (SELECT arm, count(*) AS cases, count(*) FILTER (valid AND verdict = truth) AS matches FROM results GROUP BY arm),
u AS (SELECT arm, count(*) FILTER ({_KNOWN}) = count(*) AS c, sum(input_tokens + output_tokens) FILTER ({_KNOWN}) AS n FROM calls GROUP BY arm)
SELECT d.cases AS direct_cases, d.matches AS direct_matches, h.cases AS harness_cases, h.matches AS harness_matches,
  d.matches = d.cases AND h.matches = h.cases AND du.c AND hu.c AND hu.n <= 0.8 * du.n AS met
FROM a d, a h, u du, u hu WHERE d.arm = 'direct' AND h.arm = 'harness' AND du.arm = 'direct' AND hu.arm = 'harness'""".replace("\n, a AS", ", a AS", 1)))
def efficiency_rule(t):
    """Every planned case right in both arms at no more than 0.8 of the direct tokens."""
    rows = _results(t)
    per = rows.groupBy("arm").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("valid") & (F.col("verdict") == F.col("truth"))).alias("matches"))
    use = U.combine_usage(U.usage_partials(D.calls(t), "arm"), "arm").select("arm", "usage_complete", "total_tokens")
    return U.efficiency_met(per.join(use, "arm"), F.col("direct_cases")).select(
        "direct_cases", "direct_matches", "harness_cases", "harness_matches", "met")


@query("A17", D.with_ctes(_RESULTS, body="""
SELECT arm, round(count(*) FILTER (verdict = truth) / count(*), 9) AS accuracy,
  round(count(*) FILTER (truth = 'supported' AND verdict = 'supported') / nullif(count(*) FILTER (truth = 'supported'), 0), 9) AS true_recall,
  round(count(*) FILTER (truth <> 'supported' AND verdict = 'contradicted') / nullif(count(*) FILTER (truth <> 'supported'), 0), 9) AS false_recall,
  round(count(*) FILTER (verdict = 'unresolved') / count(*), 9) AS abstention_rate, round(count(*) FILTER (valid) / count(*), 9) AS completion_rate
FROM results GROUP BY arm"""))
def recall_metrics(t):
    """True and false recall, abstention and completion rate per arm."""
    label = lambda c: F.when(c == "supported", "true").when(c == "contradicted", "false").when(c == "conflicting", "disputed").otherwise("unverifiable")
    rows = _results(t).select("arm", label(F.col("truth")).alias("truth"), label(F.col("verdict")).alias("decision"),
                              F.when(F.col("valid"), "completed").otherwise("error").alias("status"))
    out = U.recall_metrics(rows)
    return out.select("arm", *[F.round(c, 9).alias(c) for c in out.columns if c != "arm"])


@query("A18", D.with_ctes(_RESULTS, body="""
, r AS (SELECT arm, CASE WHEN truth IN ('contradicted', 'conflicting') THEN 'elevated' ELSE 'ordinary' END AS expected,
  CASE WHEN valid THEN CASE WHEN verdict IN ('contradicted', 'conflicting') THEN 'elevated' ELSE 'ordinary' END END AS predicted FROM results),
s AS (SELECT arm, count(*) FILTER (expected = 'elevated' AND predicted = 'elevated') / count(*) FILTER (expected = 'elevated') AS se,
  count(*) FILTER (expected = 'ordinary' AND predicted = 'ordinary') / count(*) FILTER (expected = 'ordinary') AS sp FROM r GROUP BY arm),
b AS (SELECT arm, se, sp, (se + sp) / 2 AS ba FROM s)
SELECT arm, round(se, 9) AS sensitivity, round(sp, 9) AS specificity, round(ba, 9) AS balanced_accuracy,
  (SELECT CASE WHEN h.ba > d.ba THEN 'harness' WHEN h.ba < d.ba THEN 'direct' ELSE 'tie' END FROM b d, b h WHERE d.arm = 'direct' AND h.arm = 'harness') AS winner
FROM b""".replace("\n, r AS", ", r AS", 1)))
def balanced_accuracy(t):
    """Sensitivity, specificity, balanced accuracy per arm and the winner."""
    risk = lambda c: F.when(c.isin("contradicted", "conflicting"), "elevated").otherwise("ordinary")
    rows = _results(t).select("arm", risk(F.col("truth")).alias("expected"), risk(F.col("verdict")).alias("predicted"), F.col("valid").alias("evidence_valid"))
    out = U.balanced_accuracy(rows)
    best = U.side_by_side(out, ("direct", "harness"), ["balanced_accuracy"]).select(
        U.winner(F.col("harness_balanced_accuracy"), F.col("direct_balanced_accuracy"), "harness", "direct").alias("winner"))
    return out.select("arm", *[F.round(c, 9).alias(c) for c in ("sensitivity", "specificity", "balanced_accuracy")]).join(F.broadcast(best))


_OUTCOMES = """o AS (
  SELECT l.doc_id AS id, CASE WHEN lang = 'en' THEN 'original' ELSE 'blinded' END AS variant, CASE WHEN j = 0 THEN 'direct' ELSE 'harness' END AS arm,
    CASE WHEN toxic = 0 AND quality = 1 THEN 'attribution_control' ELSE 'authenticity' END AS role,
    CASE WHEN j = 0 THEN length(text) >= 200 ELSE regexp_matches(text, '[.!?]\\s*$') END AS valid,
    CASE WHEN shown >= 60 THEN 'supported' WHEN shown >= 45 THEN 'contradicted' WHEN shown >= 30 THEN 'conflicting' ELSE 'unresolved' END AS observed,
    CASE WHEN toxic = 0 AND quality = 1 THEN 'supported' ELSE 'unresolved' END AS cutoff_expected,
    CASE WHEN toxic = 0 AND quality = 1 THEN 'supported' ELSE 'contradicted' END AS future_expected,
    CASE WHEN toxic = 1 OR (j = 1 AND quality = 0) THEN 'high' ELSE 'low' END AS fraud_risk, length(text) // 4 AS asked, len(regexp_extract_all(text, '[^ ]+')) AS words
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id, (VALUES (0), (1)) v(j),
    LATERAL (SELECT 1000 * (length(text) - length(replace(text, CASE WHEN j = 0 THEN 'e' ELSE 'o' END, ''))) // greatest(length(text), 1) AS shown) q)"""


def _outcomes(t):
    """Two arms judge every labelled text by how often a letter occurs in it; what was right comes from the labels."""
    x, n, j = F.col("text"), F.length("text"), F.col("j")
    control = (F.col("toxic") == 0) & (F.col("quality") == 1)
    letters = F.length(F.when(j == 0, F.replace(x, F.lit("e"), F.lit(""))).otherwise(F.replace(x, F.lit("o"), F.lit(""))))
    shown = F.floor(F.lit(1000) * (n - letters) / F.greatest(n, F.lit(1)))
    rows = t("labels").join(t("documents").select("doc_id", "lang", "text"), "doc_id").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(
        F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "original").otherwise("blinded").alias("variant"),
        F.when(j == 0, "direct").otherwise("harness").alias("arm"), F.when(control, "attribution_control").otherwise("authenticity").alias("role"),
        F.when(j == 0, n >= 200).otherwise(x.rlike(r"[.!?]\s*$")).alias("valid"),
        F.when(shown >= 60, "supported").when(shown >= 45, "contradicted").when(shown >= 30, "conflicting").otherwise("unresolved").alias("observed"),
        F.when(control, "supported").otherwise("unresolved").alias("cutoff_expected"),
        F.when(control, "supported").otherwise("contradicted").alias("future_expected"),
        F.when((F.col("toxic") == 1) | ((j == 1) & (F.col("quality") == 0)), "high").otherwise("low").alias("fraud_risk"),
        F.floor(n / 4).alias("asked"), F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), 0)).alias("words"))


@query("A24 A39", D.with_ctes(_OUTCOMES, body="""
SELECT variant, arm, count(*) AS cases, count(*) FILTER (valid) AS valid, count(*) FILTER (valid AND observed = cutoff_expected) AS cutoff_matches,
  count(*) FILTER (role = 'authenticity') AS claims, count(*) FILTER (role = 'authenticity' AND valid AND observed = 'unresolved') AS claim_abstentions,
  count(*) FILTER (role = 'authenticity' AND valid AND observed = 'supported') AS claims_accepted,
  count(*) FILTER (role = 'authenticity' AND valid AND observed = 'contradicted') AS claims_called_false,
  count(*) FILTER (valid AND cutoff_expected = 'unresolved' AND observed <> 'unresolved') AS unwarranted_settled,
  count(*) FILTER (role = 'attribution_control') AS controls,
  count(*) FILTER (role = 'attribution_control' AND valid AND observed = cutoff_expected) AS control_matches FROM o GROUP BY variant, arm"""))
def outcome_counts(t):
    """Outcome counts by variant, arm and role."""
    return U.outcome_counts(_outcomes(t))


@query("A39", D.with_ctes(_OUTCOMES, body="""
SELECT id, arm, valid AND observed = cutoff_expected AS cutoff_match, valid AND observed = future_expected AS future_match,
  valid AND observed = 'unresolved' AS abstained, valid AND role = 'authenticity' AND observed = 'supported' AS accepted_later_false,
  valid AND role = 'authenticity' AND observed = 'contradicted' AS called_later_false,
  valid AND cutoff_expected = 'unresolved' AND observed <> 'unresolved' AS unwarranted_settled FROM o"""))
def outcome_flags(t):
    """Outcome flags per row."""
    return _outcomes(t).withColumns(U.outcome_flags()).select("id", "arm", *U.outcome_flags())


@query("A44", D.with_ctes(_OUTCOMES, body="""
SELECT count(*) AS cases, count(*) FILTER (valid AND observed = cutoff_expected) AS strict_correct, count(*) FILTER (future_expected = 'contradicted') AS later_false,
  count(*) FILTER (future_expected = 'contradicted' AND valid AND fraud_risk = 'high') AS detected,
  count(*) FILTER (future_expected <> 'contradicted' AND valid AND fraud_risk = 'high') AS control_flags,
  CAST(sum(words) AS BIGINT) AS tokens, CAST(sum(asked) AS BIGINT) AS direct_tokens, round(sum(words) / sum(asked)::DOUBLE, 9) AS token_ratio,
  count(*) FILTER (valid AND observed = cutoff_expected) >= 0.75 * count(*) AS accuracy_goal,
  count(*) FILTER (future_expected = 'contradicted' AND valid AND fraud_risk = 'high') = count(*) FILTER (future_expected = 'contradicted') AS detection_goal,
  sum(words) / sum(asked)::DOUBLE <= 2 AS token_goal FROM o"""))
def screening_summary(t):
    """Screening summary with its goal booleans."""
    return U.screening(_outcomes(t), F.col("asked"), F.col("words")).withColumn("token_ratio", F.round("token_ratio", 9))


@query("A47", """
SELECT event_id, CAST(floor(value) AS BIGINT) AS input_tokens, event_id % 40 AS output_tokens,
  CASE event_id % 3 WHEN 0 THEN event_id % 11 WHEN 1 THEN event_id % 13 ELSE event_id % 17 END AS cached_input_tokens,
  CASE event_id % 3 WHEN 0 THEN event_id % 5 WHEN 1 THEN event_id % 7 END AS reasoning_output_tokens,
  CASE WHEN event_id % 4 = 0 THEN event_id % 1000 ELSE CAST(floor(value) AS BIGINT) + event_id % 40 END AS total_tokens FROM events""")
def usage_normalised(t):
    """Flat and nested usage reports brought to one shape."""
    i = F.col("event_id")
    m = i % 3
    usage = F.struct(
        F.floor("value").alias("input_tokens"), (i % 40).alias("output_tokens"), F.when(i % 4 == 0, i % 1000).alias("total_tokens"),
        F.when(m == 0, i % 11).alias("cached_input_tokens"), F.when(m == 2, i % 17).alias("cache_read_input_tokens"),
        F.when(m == 0, i % 5).alias("reasoning_output_tokens"), F.lit(None).cast("long").alias("reasoning_tokens"),
        F.struct(F.when(m == 1, i % 13).alias("cached_tokens")).alias("input_tokens_details"),
        F.struct(F.when(m == 1, i % 7).alias("reasoning_tokens")).alias("output_tokens_details"))
    return t("events").select("event_id", U.normalized_usage(usage).alias("u")).select("event_id", "u.*")


@query("A40", """
WITH c AS (SELECT user_id AS run_id, bool_and(event_type <> 'error') AS ok, count(*) AS calls FROM events WHERE user_id % 3 <> 0 GROUP BY ALL)
SELECT r.run_id, coalesce(calls, 0) AS calls,
  coalesce(run_id_ok AND calls > 0 AND ok AND r.errors = 0, false) AS completed, r.run_id % 5 = 0 OR r.run_id % 7 = 0 AS clock_discrepancy
FROM (SELECT c_custkey AS run_id, c_custkey % 4 <> 0 AND c_custkey % 11 <> 0 AS run_id_ok, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS errors FROM customer) r
LEFT JOIN c ON c.run_id = r.run_id""")
def run_completion(t):
    """Which runs completed, and where timer and clock disagree."""
    i = F.col("c_custkey")
    runs = t("customer").select(
        i.alias("run_id"), (i % 4 != 0).alias("shape_valid"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("errors"),
        F.lit("supported").alias("verdict"), F.when(i % 11 == 0, "unresolved").otherwise("supported").alias("visible_verdict"),
        F.when(i % 7 != 0, F.lit(10.0)).alias("timer_seconds"), F.when(i % 5 == 0, F.lit(12.5)).otherwise(F.lit(10.5)).alias("utc_seconds"))
    calls = t("events").filter("user_id % 3 <> 0").select(F.col("user_id").alias("run_id"), (F.col("event_type") != "error").alias("success"))
    return U.run_completion(runs, calls).select("run_id", "calls", "completed", "clock_discrepancy")


@query("A41", """
WITH ph AS (SELECT user_id AS run_id, event_type AS stage, CASE WHEN event_type = 'view' THEN 'skipped' WHEN event_id % 997 = 0 THEN 'failed' ELSE 'completed' END AS status
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE event_type <> 'view' OR rn = 1),
ca AS (SELECT user_id AS run_id, event_type AS stage, value > 1 AS success FROM events WHERE event_type <> 'view' OR user_id % 10 = 0),
r AS (SELECT run_id, count(*) FILTER (status = 'failed') AS failed, bool_or(stage = 'click' AND status = 'completed') AS dc, bool_or(stage = 'signup' AND status = 'completed') AS ds,
    count(*) FILTER (stage = 'view') AS ov FROM ph GROUP BY run_id),
k AS (SELECT run_id, bool_or(stage = 'click' AND success) AS tc, bool_or(stage = 'signup' AND success) AS ts, count(*) FILTER (stage = 'view') AS cv FROM ca GROUP BY run_id)
SELECT r.run_id, concat_ws(',', CASE WHEN NOT coalesce(dc AND tc, false) THEN 'click' END, CASE WHEN NOT coalesce(ds AND ts, false) THEN 'signup' END) AS missing_stages,
  coalesce(dc AND tc, false) AND coalesce(ds AND ts, false) AND ov = 1 AND coalesce(cv, 0) = 0 AND failed = 0 AS complete
FROM r LEFT JOIN k ON k.run_id = r.run_id""")
def stage_completion(t):
    """Required stages completed and attempted; the omitted stage skipped once."""
    e = t("events")
    once = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("event_id")).withColumn("event_type", F.lit("view"))
    phases = e.filter("event_type <> 'view'").select("user_id", "event_id", "event_type").unionByName(once).select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"),
        F.when(F.col("event_type") == "view", "skipped").when(F.col("event_id") % 997 == 0, "failed").otherwise("completed").alias("status"))
    calls = e.filter("event_type <> 'view' OR user_id % 10 = 0").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), (F.col("value") > 1).alias("success"))
    return U.stage_completion(phases, calls, ["click", "signup"], ["view"])


@query("A42", D.with_ctes(D.CALLS_SQL, body="""
, r AS (SELECT case_id, count(*) AS n, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS tokens FROM calls GROUP BY case_id),
s AS (SELECT case_id + CASE WHEN case_id % 29 = 0 THEN 100000 ELSE 0 END AS case_id, n + CASE WHEN case_id % 5 = 0 THEN 1 ELSE 0 END AS n,
  CASE WHEN case_id % 7 = 0 THEN NULL ELSE tokens END AS tokens FROM r)
SELECT coalesce(r.case_id, s.case_id) AS case_id, CASE WHEN r.case_id IS NULL THEN 'stored_only' WHEN s.case_id IS NULL THEN 'recomputed_only' ELSE 'differs' END AS problem,
  concat_ws(',', CASE WHEN r.n IS DISTINCT FROM s.n THEN 'n' END, CASE WHEN r.tokens IS DISTINCT FROM s.tokens THEN 'tokens' END) AS fields
FROM r FULL OUTER JOIN s ON r.case_id = s.case_id WHERE r.case_id IS NULL OR s.case_id IS NULL OR r.n IS DISTINCT FROM s.n OR r.tokens IS DISTINCT FROM s.tokens""".replace("\n, r AS", ", r AS", 1)))
def reconcile_totals(t):
    """Stored per-case totals against totals recomputed from the calls."""
    r = D.calls(t).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens"))
    i = F.col("case_id")
    s = r.select((i + F.when(i % 29 == 0, 100000).otherwise(0)).alias("case_id"), (F.col("n") + F.when(i % 5 == 0, 1).otherwise(0)).alias("n"),
                 F.when(i % 7 != 0, F.col("tokens")).alias("tokens"))
    return U.reconcile(r, s, ["case_id"], ["n", "tokens"])


@query("A43 U5", D.with_ctes(D.CALLS_SQL, body="""
SELECT (SELECT count(DISTINCT arm) FROM calls) AS arms, (SELECT max(m) FROM (SELECT count(DISTINCT sequence % 2) AS m FROM calls GROUP BY arm)) AS most_models,
  (SELECT count(*) FROM (SELECT sequence // 3 AS r FROM calls GROUP BY r HAVING count(DISTINCT arm) > 1)) AS shared_responses"""))
def model_consistency(t):
    """Actual models per arm and response ids that both arms used."""
    c = D.calls(t).withColumns({"actual_model": F.concat(F.lit("model"), (F.col("sequence") % 2).cast("string")),
                                "response_id": F.floor(F.col("sequence") / 3)})
    shared = U.shared_responses(c).agg(F.count(F.lit(1)).alias("shared_responses"))
    return U.single_model(c).select("arms", "most_models").join(F.broadcast(shared))


@query("J25", """
WITH r AS (SELECT doc_id AS case_id, CASE WHEN n_chars % 5 = 0 THEN 'error' ELSE 'completed' END AS status,
    ['true','false','disputed','unverifiable','maybe'][(n_chars % 5) + 1] AS decision, n_chars % 11 <> 0 AS ok,
    CASE WHEN n_chars % 5 = 0 THEN 'Timeout' END AS error_type FROM documents WHERE n_chars % 4 <> 0)
SELECT d.doc_id AS case_id, CASE WHEN v THEN 'completed' ELSE 'error' END AS status, CASE WHEN v THEN decision ELSE 'unverifiable' END AS decision,
  CASE WHEN v THEN NULL WHEN coalesce(status = 'completed', false) THEN 'InvalidPrediction' ELSE coalesce(error_type, 'MissingArmResult') END AS error_type
FROM documents d LEFT JOIN (SELECT *, coalesce(status = 'completed' AND decision <> 'maybe' AND ok, false) AS v FROM r) r ON r.case_id = d.doc_id""")
def arm_normalise(t):
    """Every expected case kept; missing or invalid rows are errors."""
    n = F.col("n_chars")
    rows = t("documents").filter(n % 4 != 0).select(
        F.col("doc_id").alias("case_id"), F.when(n % 5 == 0, "error").otherwise("completed").alias("status"),
        D.pick(n % 5, "true", "false", "disputed", "unverifiable", "maybe").alias("decision"), (n % 11 != 0).alias("assessment_valid"),
        F.when(n % 5 == 0, "Timeout").alias("error_type"))
    return U.normalized_arm(t("documents").select(F.col("doc_id").alias("case_id")), rows)


@query("J26 U1", """
WITH r AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'loop' ELSE 'full' END AS variant,
    CASE WHEN n_chars % 13 = 0 THEN 'halted' WHEN n_chars % 3 = 0 THEN 'error' ELSE 'completed' END AS status,
    CASE WHEN n_chars % 6 = 0 OR n_chars % 17 = 0 THEN 'E' END AS error_type FROM documents WHERE n_chars % 10 <> 0
  UNION ALL SELECT doc_id, 'loop', 'completed', NULL FROM documents WHERE doc_id % 31 = 0),
p AS (SELECT case_id, variant, count(*) AS n, count(*) FILTER (status = 'halted') AS b, count(*) FILTER (status = 'error' AND error_type IS NULL) AS ne,
    count(*) FILTER (status = 'completed' AND error_type IS NOT NULL) AS se FROM r GROUP BY ALL),
e AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'loop' ELSE 'full' END AS variant FROM documents),
j AS (SELECT coalesce(p.case_id, e.case_id) AS case_id, coalesce(p.variant, e.variant) AS variant, concat_ws(',', CASE WHEN n IS NULL THEN 'missing_row' END,
  CASE WHEN e.case_id IS NULL THEN 'unexpected_row' END, CASE WHEN n > 1 THEN 'duplicate_row' END, CASE WHEN b > 0 THEN 'invalid_status' END,
  CASE WHEN ne > 0 THEN 'error_without_type' END, CASE WHEN se > 0 THEN 'completed_with_error' END) AS reasons
  FROM p FULL OUTER JOIN e ON p.case_id = e.case_id AND p.variant = e.variant)
SELECT * FROM j WHERE reasons <> ''""")
def raw_row_contract(t):
    """Raw rows against the exact set of expected (case, variant) pairs."""
    i, n = F.col("doc_id"), F.col("n_chars")
    d = t("documents").select("doc_id", "n_chars")
    variant = F.when(i % 2 == 0, "loop").otherwise("full")
    rows = d.filter(n % 10 != 0).select(
        i.alias("case_id"), variant.alias("variant"), F.when(n % 13 == 0, "halted").when(n % 3 == 0, "error").otherwise("completed").alias("status"),
        F.when((n % 6 == 0) | (n % 17 == 0), "E").alias("error_type"))
    extra = d.filter(i % 31 == 0).select(i.alias("case_id"), F.lit("loop").alias("variant"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error_type"))
    out = U.raw_row_codes(rows.unionByName(extra), d.select(i.alias("case_id"), variant.alias("variant")))
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("J22", D.with_ctes(D.CASES_SQL, body="""
SELECT diagnosis, count(*) AS cases FROM (SELECT CASE WHEN id % 13 = 0 THEN 'control_error' WHEN c <> truth THEN 'semantic_failure_with_full_evidence'
  WHEN decision <> truth THEN 'loop_or_evidence_access_failure' ELSE 'loop_and_full_evidence_agree_with_gold' END AS diagnosis
  FROM (SELECT *, CASE WHEN id % 4 = 0 THEN decision ELSE truth END AS c FROM cases)) GROUP BY diagnosis"""))
def control_diagnosis(t):
    """Loop failures told apart from failures that full evidence does not fix."""
    rows = D.cases(t)
    loop = rows.select("id", F.col("decision").alias("loop"))
    control = rows.select("id", F.when(F.col("id") % 4 == 0, F.col("decision")).otherwise(F.col("truth")).alias("control"),
                          F.when(F.col("id") % 13 == 0, "error").otherwise("completed").alias("control_status"))
    out = rows.select("id", "truth").join(loop, "id").join(control, "id")
    return out.groupBy(U.control_diagnosis(F.col("truth"), F.col("loop"), F.col("control"), F.col("control_status")).alias("diagnosis")).agg(
        F.count(F.lit(1)).alias("cases"))


@query("F22", """
SELECT event_id, concat_ws(',', CASE WHEN r > 60 THEN 'retrieval_calls' END, CASE WHEN m < 0 OR m > 500 OR m <> floor(m) THEN 'model_tokens' END,
  CASE WHEN w > 20 THEN 'wall_seconds' END) AS violations
FROM (SELECT event_id, event_id % 70 AS r, value * 10 - 5 AS m, value AS w FROM events)""")
def budget_violations(t):
    """Usage above its per-target ceiling, negative or not whole where it counts things."""
    from ..operators.admission import usage_codes
    i = F.col("event_id")
    usage = t("events").select(i, F.lit("run").alias("run"), (i % 70).alias("retrieval_calls"), (F.col("value") * 10 - 5).alias("model_tokens"), F.col("value").alias("wall_seconds"))
    budget = t("region").agg(F.lit(60).alias("retrieval_calls_budget"), F.lit(500).alias("model_tokens_budget"), F.lit(20.0).alias("wall_seconds_budget"),
                             F.min(F.lit("run")).alias("run"))
    return usage_codes(usage, budget).select("event_id", F.array_join("violations", ",").alias("violations"))


@query("A29", """
SELECT count(*) AS items, CAST(sum(n) AS BIGINT) AS claims, CAST(sum(l) AS BIGINT) AS located, count(*) FILTER (l = n) AS completed,
  count(*) FILTER (l > 0 AND l < n) AS partial, count(*) FILTER (l = 0) AS failed
FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (length(text) % 2 = 0) AS l FROM conversations GROUP BY conv_id)""")
def batch_status(t):
    """Items by final status with claim and located totals."""
    items = t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.length("text") % 2 == 0).alias("located"))
    return U.batch_status(items.withColumn("status", F.when(F.col("located") == F.col("claims"), "completed").when(F.col("located") > 0, "partial").otherwise("failed")))
