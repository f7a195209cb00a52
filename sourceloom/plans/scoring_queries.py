"""Gold against predictions, intervals, calibration and the event bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import scoring as M
from ..session import cut
from . import derive as D
from .registry import query

_FACTS = f"""{D.CASES_SQL}, {D.GOLD_EDGES_SQL}, {D.PRED_EDGES_SQL}, {D.CASE_EVIDENCE_SQL},
reach_p AS (SELECT id, 'case' || id AS node FROM cases
  UNION SELECT r.id, e."to" FROM reach_p r JOIN pred_edges e ON e.id = r.id AND e."from" = r.node),
ed AS (SELECT p.id, count(*) AS edges_predicted, count(g.id) AS edges_correct FROM pred_edges p
  LEFT JOIN gold_edges g ON g.id = p.id AND g."from" = p."from" AND g."to" = p."to" AND g.relation = p.relation GROUP BY p.id),
ge AS (SELECT id, count(*) AS edges_gold FROM gold_edges GROUP BY id),
rr AS (SELECT c.id, count(*) AS reached FROM (SELECT id, unnest(roots) AS node FROM cases) c JOIN reach_p r ON r.id = c.id AND r.node = c.node GROUP BY c.id),
evc AS (SELECT id, count(*) FILTER (gold_stance = 'supports') AS gold_supports, count(*) FILTER (reported) AS evidence_reported,
  count(*) FILTER (reported AND stance = gold_stance) AS stance_correct, count(*) FILTER (reported AND stance = 'supports') AS support_claims,
  count(*) FILTER (reported AND stance = 'supports' AND stance = gold_stance) AS support_correct FROM case_evidence GROUP BY id),
prs AS (SELECT a.id, count(*) FILTER (a.gold_origin = b.gold_origin AND coalesce(a.origin = b.origin, false)) AS duplicate_tp,
  count(*) FILTER (a.gold_origin <> b.gold_origin AND coalesce(a.origin = b.origin, false)) AS duplicate_fp,
  count(*) FILTER (a.gold_origin = b.gold_origin AND NOT coalesce(a.origin = b.origin, false)) AS duplicate_fn
  FROM case_evidence a JOIN case_evidence b ON a.id = b.id AND a.evidence < b.evidence GROUP BY a.id),
facts AS (SELECT c.id, c.event_id, 1 AS cases, (decision = 'true')::BIGINT AS accepted, (truth = 'true')::BIGINT AS "true",
  (truth = 'false')::BIGINT AS "false", (decision = 'true' AND truth = 'true')::BIGINT AS accepted_true,
  (decision <> 'true' AND truth = 'false')::BIGINT AS blocked_false, (high_risk AND truth = 'false')::BIGINT AS high_false,
  (decision = 'true' AND high_risk AND truth = 'false')::BIGINT AS accepted_high_false, (decision = truth)::BIGINT AS correct_label,
  (truth = 'false' AND decision = 'false')::BIGINT AS false_identified, traceable::BIGINT AS traceable,
  (NOT traceable)::BIGINT AS untraceable, (source_status = 'resolved')::BIGINT AS source_resolved,
  (source_status = 'resolved' AND NOT traceable)::BIGINT AS false_root,
  (source_status = 'resolved' AND traceable AND (list_sort(roots) = [root] OR list_sort(roots) = list_sort([root, 'root_shared']))
    AND edges_correct = edges_predicted AND coalesce(reached, 0) = len(roots))::BIGINT AS source_correct,
  edges_correct, edges_predicted, edges_gold, evc.* EXCLUDE (id), prs.* EXCLUDE (id),
  (p_true - (truth = 'true')::INT)^2 + (p_false - (truth = 'false')::INT)^2 + (p_disputed - (truth = 'disputed')::INT)^2
    + (p_unverifiable - (truth = 'unverifiable')::INT)^2 AS brier,
  greatest(p_true, p_false, p_disputed, p_unverifiable) AS confidence,
  (CASE greatest(p_true, p_false, p_disputed, p_unverifiable) WHEN p_true THEN 'true' WHEN p_false THEN 'false'
    WHEN p_disputed THEN 'disputed' ELSE 'unverifiable' END = truth)::BIGINT AS top_correct
  FROM cases c JOIN ed ON ed.id = c.id JOIN ge ON ge.id = c.id LEFT JOIN rr ON rr.id = c.id JOIN evc ON evc.id = c.id JOIN prs ON prs.id = c.id)"""

_SUMS = ", ".join(f'sum("{c}") AS "{c}"' for c in [*M.COUNTERS, *M.PAIR_COUNTERS])
_RATIO_SQL = {k: f'"{a}"::DOUBLE / nullif("{b}", 0)' for k, (a, b) in M.RATIOS.items()}
_SCORE = "100 * " + " * ".join(f'pow("{k}", {w})' for k, w in M.WEIGHTS.items()) + ' * pow(1 - "HFAR", 2)'


def _facts(t):
    return M.case_facts(D.cases(t), D.case_edges(t, False), D.case_edges(t, True), D.case_evidence(t), F.concat(F.lit("case"), F.col("id")))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) + F.lit(0.0) for n in names})


_METRICS = f"""s AS (SELECT {_SUMS}, sum(brier) AS brier_sum FROM facts),
ece AS (SELECT sum(abs(gap)) AS gap FROM (SELECT sum(confidence - top_correct) AS gap FROM facts
  GROUP BY least(9, CAST(floor(confidence * 10) AS BIGINT)))),
m AS (SELECT {', '.join(f'{v} AS "{k}"' for k, v in _RATIO_SQL.items())}, brier_sum / cases AS brier,
  1 - brier_sum / cases / 2 AS "CA", (SELECT gap FROM ece) / cases AS "ECE10",
  2.0 * duplicate_tp / nullif(2 * duplicate_tp + duplicate_fp + duplicate_fn, 0) AS duplicate_pair_f1 FROM s),
wide AS (SELECT *, {_SCORE} AS score FROM m)"""
_NAMES = [*M.RATIOS, "brier", "CA", "ECE10", "duplicate_pair_f1", "score"]
_LONG = " UNION ALL ".join(f"SELECT '{n}' AS metric, round(\"{n}\", 9) AS value FROM wide" for n in _NAMES)


@query("J1 A3 A4 A5 A6 A8 A9 A10 A11 A12 A45 J9 G11 U3", D.with_ctes(_FACTS, _METRICS, body=_LONG))
def gold_prediction_metrics(t):
    """Every named metric and diagnostic as (metric, value) rows."""
    return M.metric_rows(M.metrics(_facts(t))).withColumn("value", F.round("value", 9))


@query("A2", D.with_ctes(D.CASES_SQL, body="""
SELECT event_id, accepted_true, accepted, round(p, 9) AS value,
  CASE WHEN n > 0 THEN round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) END AS low,
  CASE WHEN n > 0 THEN round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) END AS high
FROM (SELECT event_id, count(*) FILTER (decision = 'true' AND truth = 'true') AS accepted_true,
  count(*) FILTER (decision = 'true') AS accepted, 1.959963984540054 AS z,
  CASE WHEN count(*) FILTER (decision = 'true') > 0 THEN count(*) FILTER (decision = 'true')::DOUBLE END AS n,
  count(*) FILTER (decision = 'true' AND truth = 'true') / CASE WHEN count(*) FILTER (decision = 'true') > 0 THEN count(*) FILTER (decision = 'true')::DOUBLE END AS p
  FROM cases GROUP BY event_id)"""))
def wilson_by_event(t):
    """Accepted-and-true ratio with its Wilson interval per event; null where nothing was accepted."""
    sums = D.cases(t).withColumns(M.case_counters()).groupBy("event_id").agg(
        F.sum("accepted_true").alias("accepted_true"), F.sum("accepted").alias("accepted"))
    w = M.wilson(F.col("accepted_true"), F.col("accepted"))
    return sums.select("event_id", "accepted_true", "accepted", F.round(M.ratio(F.col("accepted_true"), F.col("accepted")), 9).alias("value"),
                       F.round(w["low"], 9).alias("low"), F.round(w["high"], 9).alias("high"))


@query("A7", D.with_ctes(D.CASES_SQL, body="""
SELECT truth, count(*) FILTER (decision = 'true') AS "true", count(*) FILTER (decision = 'false') AS "false",
  count(*) FILTER (decision = 'disputed') AS disputed, count(*) FILTER (decision = 'unverifiable') AS unverifiable FROM cases GROUP BY truth"""))
def confusion_matrix(t):
    """Truth by decision with zero cells."""
    return M.confusion(D.cases(t))


@query("A8 A9", D.with_ctes(_FACTS, body="""
SELECT least(9, CAST(floor(confidence * 10) AS BIGINT)) AS bin, count(*) AS cases, round(sum(confidence), 9) AS confidence_sum,
  CAST(sum(top_correct) AS BIGINT) AS correct_sum, round(sum(brier), 9) AS brier_sum FROM facts GROUP BY bin"""))
def calibration_bins(t):
    """Ten equal-width confidence bins of the top label."""
    rows = D.cases(t).withColumns(M.calibration_columns())
    return rows.groupBy(F.col("bin").cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.sum("confidence"), 9).alias("confidence_sum"),
        F.sum("top_correct").alias("correct_sum"), F.round(F.sum("brier"), 9).alias("brier_sum"))


@query("J9 A10", """
WITH d AS (SELECT lang, md5(text) AS h, source FROM documents), c AS (SELECT lang, h, source, count(*) AS n FROM d GROUP BY ALL)
SELECT b.lang, tp AS duplicate_tp, pred - tp AS duplicate_fp, gold - tp AS duplicate_fn,
  round(2.0 * tp / nullif(2 * tp + (pred - tp) + (gold - tp), 0), 9) AS f1
FROM (SELECT lang, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS tp FROM c GROUP BY lang) b
JOIN (SELECT lang, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS gold FROM (SELECT lang, h, sum(n) AS n FROM c GROUP BY ALL) GROUP BY lang) g ON g.lang = b.lang
JOIN (SELECT lang, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pred FROM (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) GROUP BY lang) p ON p.lang = b.lang""")
def duplicate_pair_f1(t):
    """Duplicate-pair F1 per language from cell counts; no pair is ever listed."""
    rows = t("documents").select(F.col("lang").alias("id"), F.md5("text").alias("gold_origin"), F.col("source").alias("origin"))
    out = M.pair_counters(rows)
    tp, fp, fn = (F.col(f"duplicate_{x}") for x in ("tp", "fp", "fn"))
    return out.select(F.col("id").alias("lang"), *M.PAIR_COUNTERS,
                      F.round(F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")), 9).alias("f1"))


@query("A6", D.with_ctes(D.GOLD_EDGES_SQL, D.PRED_EDGES_SQL, body="""
SELECT p.relation, count(*) AS predicted, count(g.id) AS correct FROM pred_edges p
LEFT JOIN gold_edges g ON g.id = p.id AND g."from" = p."from" AND g."to" = p."to" AND g.relation = p.relation GROUP BY p.relation"""))
def edge_agreement(t):
    """Predicted typed edges and how many are annotated, by relation."""
    key = ["id", "from", "to", "relation"]
    gold = D.case_edges(t, False).withColumn("_hit", F.lit(1))
    return D.case_edges(t, True).join(gold, key, "left").groupBy("relation").agg(
        F.count(F.lit(1)).alias("predicted"), F.count("_hit").alias("correct"))


@query("J1 J2 U1", """
WITH g AS (SELECT doc_id AS id, quality AS at FROM labels),
p AS (SELECT doc_id AS id, n_chars % 2 AS at FROM documents WHERE n_chars % 3 <> 0)
SELECT coalesce(g.id, p.id) AS id, CASE WHEN p.id IS NULL THEN 'missing_prediction' WHEN g.id IS NULL THEN 'extra_prediction'
  ELSE 'cutoff_mismatch' END AS problem FROM g FULL OUTER JOIN p ON g.id = p.id WHERE p.id IS NULL OR g.id IS NULL OR g.at <> p.at""")
def coverage_problems(t):
    """Missing, extra and cutoff-mismatched cases between gold and predictions."""
    gold = t("labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("as_of"))
    pred = t("documents").filter("n_chars % 3 <> 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 2).cast("string").alias("as_of"))
    return M.coverage(gold, pred)


@query("U2", """
WITH p AS (SELECT DISTINCT source AS case_id, md5(text) AS evidence_id FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT source AS case_id, md5(text) AS evidence_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND text IS NOT NULL)
SELECT * FROM p EXCEPT SELECT * FROM g""")
def unjudged_evidence(t):
    """Evidence texts of each source that no accepted label covers."""
    rows = t("documents").filter("text IS NOT NULL").select("doc_id", F.col("source").alias("case_id"), F.md5("text").alias("evidence_id"))
    return M.unjudged(rows, rows.join(t("labels").filter("quality = 1"), "doc_id", "left_semi"), ["case_id", "evidence_id"])


@query("J10", D.with_ctes(D.CALLS_SQL, body="""
, s AS (SELECT arm, case_id, CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS tokens FROM calls GROUP BY ALL)
SELECT a.case_id, a.tokens AS baseline, b.tokens AS candidate, b.tokens - a.tokens AS delta FROM s a JOIN s b ON a.case_id = b.case_id
WHERE a.arm = 'direct' AND b.arm = 'harness'""").replace("\n\n, s AS", ", s AS").replace("\n, s AS", ", s AS"))
def paired_case_tokens(t):
    """Both arms' tokens per case and their difference."""
    s = D.calls(t).groupBy("arm", "case_id").agg(
        F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"))
    return M.paired(s.filter("arm = 'direct'"), s.filter("arm = 'harness'"), "case_id", "tokens")


_DRAWS = 40
_BOOT = f"""{_FACTS},
arms AS (SELECT 'a' AS arm, * FROM facts UNION ALL SELECT 'b', * REPLACE (
    (id % 2 = 0)::BIGINT * "true" + (id % 2 <> 0)::BIGINT * accepted_true AS accepted_true,
    (id % 2 = 0)::BIGINT * "true" + (id % 2 <> 0)::BIGINT * accepted AS accepted,
    (id % 2 = 0)::BIGINT + (id % 2 <> 0)::BIGINT * correct_label AS correct_label) FROM facts),
pe AS (SELECT arm, event_id, {_SUMS}, sum(brier) AS brier_sum,
    {', '.join(f"coalesce(sum(confidence - top_correct) FILTER (least(9, CAST(floor(confidence * 10) AS BIGINT)) = {b}), 0) AS bin_{b}" for b in range(10))}
  FROM arms GROUP BY ALL),
num AS (SELECT event_id, row_number() OVER (ORDER BY md5(event_id), event_id) - 1 AS event_no, count(*) OVER () AS n FROM (SELECT DISTINCT event_id FROM pe)),
dr AS (SELECT draw, (('0x' || substr(md5('7|' || draw || '|' || event_no), 1, 15))::BIGINT) % n AS event_no, count(*) AS times
  FROM num, (SELECT unnest(range({_DRAWS})) AS draw) GROUP BY ALL),
w AS (SELECT draw, event_id, times FROM dr JOIN num USING (event_no) UNION ALL SELECT -1, event_id, 1 FROM num),
dsum AS (SELECT arm, draw, {', '.join(f'sum("{c}" * times) AS "{c}"' for c in [*M.COUNTERS, *M.PAIR_COUNTERS, 'brier_sum', *[f'bin_{b}' for b in range(10)]])}
  FROM pe JOIN w ON w.event_id = pe.event_id GROUP BY ALL),
dm AS (SELECT arm, draw, {', '.join(f'{v} AS "{k}"' for k, v in _RATIO_SQL.items())}, brier_sum / cases AS brier, 1 - brier_sum / cases / 2 AS "CA",
    ({' + '.join(f'abs(bin_{b})' for b in range(10))}) / cases AS "ECE10",
    2.0 * duplicate_tp / nullif(2 * duplicate_tp + duplicate_fp + duplicate_fn, 0) AS duplicate_pair_f1 FROM dsum),
dl AS (SELECT *, {_SCORE} AS score FROM dm),
lg AS ({' UNION ALL '.join(f"SELECT arm, draw, '{n}' AS metric, {chr(34)}{n}{chr(34)} AS value FROM dl" for n in _NAMES)}),
d AS (SELECT metric, draw, max(value) FILTER (arm = 'b') - max(value) FILTER (arm = 'a') AS delta,
    max(value) FILTER (arm = 'a') AS baseline, max(value) FILTER (arm = 'b') AS candidate FROM lg GROUP BY ALL)"""


@query("A13 A14 A15", D.with_ctes(_BOOT, body=f"""
SELECT metric, round(max(baseline) FILTER (draw = -1), 9) + 0.0 AS baseline, round(max(candidate) FILTER (draw = -1), 9) + 0.0 AS candidate,
  round(max(delta) FILTER (draw = -1), 9) + 0.0 AS delta,
  CASE WHEN count(delta) FILTER (draw >= 0) = {_DRAWS} THEN round(quantile_cont(delta, 0.025) FILTER (draw >= 0), 9) + 0.0 END AS low,
  CASE WHEN count(delta) FILTER (draw >= 0) = {_DRAWS} THEN round(quantile_cont(delta, 0.975) FILTER (draw >= 0), 9) + 0.0 END AS high,
  count(delta) FILTER (draw >= 0) AS valid_draws,
  CASE WHEN count(delta) FILTER (draw >= 0) = {_DRAWS} THEN 'computed' ELSE 'insufficient_events_or_undefined_resample_metrics' END AS interval_status,
  CASE WHEN metric IN ('HFAR', 'unknown_source_false_promotion', 'ECE10') THEN 'lower' ELSE 'higher' END AS preferred_direction
FROM d GROUP BY metric"""))
def event_bootstrap(t):
    """Paired bootstrap over event clusters; the candidate corrects every even case."""
    facts = cut(_facts(t))
    even = F.col("id") % 2 == 0
    better = facts.withColumns({
        "accepted_true": F.when(even, F.col("true")).otherwise(F.col("accepted_true")),
        "accepted": F.when(even, F.col("true")).otherwise(F.col("accepted")),
        "correct_label": F.when(even, F.lit(1)).otherwise(F.col("correct_label")).cast("long")})
    out = B.event_bootstrap(facts, better, draws=_DRAWS, seed=7)
    return _rounded(out, "baseline", "candidate", "delta", "low", "high")
