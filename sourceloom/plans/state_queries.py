"""Gap lifecycle, progress, budgets and allocation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as S
from . import derive as D
from .registry import query

_STATE = D.GAP_EVENTS_SQL + """, st AS (
  SELECT target_id, gap_id, coalesce(max(epoch) FILTER (op = 'open'), -1) AS last_open, coalesce(max(epoch) FILTER (op = 'close'), -1) AS last_close,
    arg_max(owner, epoch) FILTER (op = 'open') AS open_owner FROM gap_events GROUP BY target_id, gap_id)"""


@query("W5 R3", D.with_ctes(_STATE, body="""
SELECT *, CASE WHEN last_open > last_close THEN 'open' ELSE 'closed' END AS state FROM st"""))
def gap_state_fold(t):
    """Open or closed per gap: the latest explicit event wins."""
    return S.gap_state(D.gap_events(t))


@query("W5 A32 U4", D.with_ctes(_STATE, body="""
SELECT e.target_id, e.gap_id, array_to_string(list_sort(list(DISTINCT basis)), ',') AS basis, array_to_string(list_sort(list(DISTINCT owner)), ' | ') AS rationale
FROM gap_events e JOIN st ON st.target_id = e.target_id AND st.gap_id = e.gap_id
WHERE op = 'close' AND last_open <= last_close AND epoch > last_open GROUP BY e.target_id, e.gap_id"""))
def combined_closures(t):
    """Live closures of each closed gap merged without losing a basis."""
    events = D.gap_events(t)
    live = S.live_closures(events, S.gap_state(events)).withColumnRenamed("owner", "rationale")
    return S.combine_closures(live).withColumn("basis", F.array_join("basis", ","))


@query("W3", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events""")
def operation_sequence(t):
    """Sequence number of every operation in its trace, counted hour by hour."""
    e = t("events").select("event_id", "user_id", "ts", F.date_trunc("hour", "ts").alias("slot"))
    return S.sequence_numbers(e, ["user_id"], "slot", [F.col("ts"), F.col("event_id")]).select("event_id", "sequence")


@query("W4", D.with_ctes(D.GAP_EVENTS_SQL, body="""
SELECT target_id, gap_id, arg_max(op, epoch) AS op, arg_max(basis, epoch) AS basis, max(epoch) AS epoch FROM gap_events GROUP BY target_id, gap_id"""))
def latest_feedback(t):
    """Latest event of each gap."""
    return S.latest_per_gap(D.gap_events(t), F.col("epoch"), "op", "basis", "epoch")


@query("W6", D.with_ctes(D.GAP_EVENTS_SQL, body="""
, p AS (SELECT *, lag(blocking) OVER (PARTITION BY target_id, gap_id ORDER BY epoch) AS was FROM gap_events),
a AS (SELECT target_id, gap_id, count(DISTINCT stage || basis) AS identities, count(*) FILTER (was AND NOT blocking) AS weakened FROM p GROUP BY ALL)
SELECT *, concat_ws(',', CASE WHEN identities > 1 THEN 'conflicting_identity' END, CASE WHEN weakened > 0 THEN 'severity_weakened' END) AS reasons FROM a
""".replace("\n, p AS", ", p AS", 1)))
def lifecycle_violations(t):
    """Gap ids whose identity changes or whose severity weakens."""
    rows = D.gap_events(t).withColumn("identity", F.concat("stage", "basis"))
    return S.lifecycle_codes(rows, "slot").withColumn("reasons", F.array_join("reasons", ","))


@query("W7", D.with_ctes(D.GAP_EVENTS_SQL, body="""
, c AS (SELECT *, lag(basis) OVER w AS pb FROM gap_events WHERE op = 'close' WINDOW w AS (PARTITION BY target_id, gap_id, owner ORDER BY epoch))
SELECT target_id, gap_id, owner, epoch, coalesce(pb <> basis, true) AS renewed,
  max(CASE WHEN coalesce(pb <> basis, true) THEN epoch END) OVER (PARTITION BY target_id, gap_id, owner ORDER BY epoch) AS effective_epoch FROM c
""".replace("\n, c AS", ", c AS", 1)))
def close_epochs(t):
    """Close epoch carried while the basis is unchanged."""
    closes = D.gap_events(t).filter("op = 'close'")
    return S.close_epochs(closes, "slot").select("target_id", "gap_id", "owner", "epoch", "renewed", "effective_epoch")


@query("W8", """
SELECT event_id, event_type, previous FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
WHERE event_type IS DISTINCT FROM previous""")
def assessment_changes(t):
    """Change events: rows whose assessment differs from the one before."""
    e = t("events").select("event_id", "user_id", "ts", "event_type", F.date_trunc("hour", "ts").alias("slot"))
    return S.change_events(e, ["user_id"], "slot", F.struct("ts", "event_id"), "event_type").select("event_id", "event_type", "previous")


@query("W9", """
WITH r AS (SELECT user_id AS trace_id, event_id AS round, event_type || json_extract_string(props, '$.k')[1:1] AS fp FROM events)
SELECT trace_id, round, CASE WHEN row_number() OVER (PARTITION BY trace_id, fp ORDER BY round) = 1 THEN 'new_structure'
  WHEN fp IS NOT DISTINCT FROM lag(fp) OVER (PARTITION BY trace_id ORDER BY round) THEN 'unchanged' ELSE 'repeated' END AS progress FROM r""")
def progress_test(t):
    """New structure, repeated or unchanged state per round."""
    r = t("events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("round"), F.date_trunc("hour", "ts").alias("slot"),
                           F.concat("event_type", F.substring(F.get_json_object("props", "$.k"), 1, 1)).alias("fingerprint"))
    return S.progress(r, "slot").select("trace_id", "round", "progress")


@query("W1", """
WITH RECURSIVE a AS (SELECT user_id AS claim_id, CAST(k % 3 + 1 AS INT) AS round, count(*) AS available FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL),
c AS (SELECT DISTINCT claim_id FROM a),
p AS (SELECT claim_id, 0 AS round, 0::BIGINT AS lim, 0::BIGINT AS examined, 0::BIGINT AS total FROM c
  UNION ALL SELECT p.claim_id, p.round + 1, CASE WHEN 30 - total > 0 THEN greatest(1, CAST(ceil((30 - total) / (3 - p.round)) AS BIGINT)) ELSE 0 END,
    least(CASE WHEN 30 - total > 0 THEN greatest(1, CAST(ceil((30 - total) / (3 - p.round)) AS BIGINT)) ELSE 0 END, coalesce(a.available, 0)),
    total + least(CASE WHEN 30 - total > 0 THEN greatest(1, CAST(ceil((30 - total) / (3 - p.round)) AS BIGINT)) ELSE 0 END, coalesce(a.available, 0))
  FROM p LEFT JOIN a ON a.claim_id = p.claim_id AND a.round = p.round + 1 WHERE p.round < 3)
SELECT claim_id, round, lim AS "limit", examined, total AS examined_total FROM p WHERE round > 0""")
def budget_spread(t):
    """Rows each round may examine when the document budget is spread over the rounds left."""
    k = F.get_json_object("props", "$.k").cast("long")
    a = t("events").groupBy(F.col("user_id").alias("claim_id"), (k % 3 + 1).alias("round")).agg(F.count(F.lit(1)).alias("available"))
    return S.round_limits(a, max_rounds=3, max_documents=30)


@query("W1", """
WITH r AS (SELECT event_id, user_id, k % 3 + 1 AS round, row_number() OVER (PARTITION BY user_id, k % 3 ORDER BY ts, event_id) AS position,
    count(*) OVER (PARTITION BY user_id, k % 3) AS n FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
a AS (SELECT user_id, coalesce(max(n) FILTER (round = 1), 0) AS a1, coalesce(max(n) FILTER (round = 2), 0) AS a2 FROM r GROUP BY user_id),
u AS (SELECT *, least(10, a1) AS t1 FROM a),
l AS (SELECT *, CAST(ceil((30 - t1) / 2) AS BIGINT) AS l2 FROM u),
m AS (SELECT *, 30 - t1 - least(l2, a2) AS l3 FROM l)
SELECT event_id, round FROM r JOIN m USING (user_id) WHERE position <= CASE round WHEN 1 THEN 10 WHEN 2 THEN l2 ELSE l3 END""")
def examined_evidence(t):
    """Evidence rows a bounded run looks at, round by round."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = t("events").select("event_id", "ts", F.col("user_id").alias("claim_id"), (k % 3 + 1).alias("round"))
    limits = S.round_limits(e.groupBy("claim_id", "round").agg(F.count(F.lit(1)).alias("available")), max_rounds=3, max_documents=30)
    return S.examined_rows(e, limits, [F.col("ts"), F.col("event_id")], 30).select("event_id", "round")


@query("W12", """
SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last, count(*) AS checkpoints FROM events GROUP BY user_id""")
def first_last_decision(t):
    """First against last checkpoint of each trace."""
    return S.first_and_last(t("events"), "user_id", F.col("event_id"), "event_type")


@query("W10", """
WITH h AS (SELECT user_id AS trace_id, event_type || (k % 5) AS version_id, event_id AS revision, k // 10 AS analysis FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY trace_id, version_id ORDER BY revision) = 1 THEN 1 ELSE 0 END AS fresh FROM h),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id ORDER BY revision) AS seen FROM f),
l AS (SELECT *, lag(revision) OVER w AS pr, lag(analysis) OVER w AS pa, lag(seen) OVER w AS ps FROM s WINDOW w AS (PARTITION BY trace_id, version_id ORDER BY revision))
SELECT trace_id, version_id, revision, pr AS previous_revision, CAST(seen - ps AS BIGINT) AS new_versions, analysis <> pa AS changed FROM l WHERE pr IS NOT NULL""")
def reanalysis_audit(t):
    """Revisions with their predecessor and the versions first seen since."""
    k = F.get_json_object("props", "$.k").cast("long")
    h = t("events").select(F.col("user_id").alias("trace_id"), F.concat("event_type", (k % 5).cast("string")).alias("version_id"),
                           F.col("event_id").alias("revision"), F.floor(k / 10).alias("analysis"), F.date_trunc("hour", "ts").alias("slot"))
    return S.reanalysis_audit(h, "slot")


@query("W11", """
WITH o AS (SELECT user_id AS trace_id, CAST(ts AS DATE) AS round, event_id AS sequence, k % 6 AS version_id,
  CASE event_type WHEN 'view' THEN 'snapshot_saved' WHEN 'click' THEN 'decompose_completed' ELSE 'verification_completed' END AS action
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
p AS (SELECT trace_id, round, version_id, min(sequence) FILTER (action = 'snapshot_saved') AS s, min(sequence) FILTER (action = 'decompose_completed') AS d
  FROM o WHERE action <> 'verification_completed' GROUP BY ALL),
v AS (SELECT trace_id, round, min(sequence) AS v FROM o WHERE action = 'verification_completed' GROUP BY ALL)
SELECT p.trace_id, count(*) AS returns, count(*) FILTER (s < d AND d < v) AS in_order FROM p LEFT JOIN v ON v.trace_id = p.trace_id AND v.round = p.round GROUP BY p.trace_id""")
def feedback_audit(t):
    """Returns that were saved, decomposed and verified in this order."""
    k = F.get_json_object("props", "$.k").cast("long")
    o = t("events").select(
        F.col("user_id").alias("trace_id"), F.to_date("ts").alias("round"), F.col("event_id").alias("sequence"), (k % 6).alias("version_id"),
        F.when(F.col("event_type") == "view", "snapshot_saved").when(F.col("event_type") == "click", "decompose_completed")
        .otherwise("verification_completed").alias("action"))
    return S.feedback_audit(o).groupBy("trace_id").agg(F.count(F.lit(1)).alias("returns"), F.count_if("in_order").alias("in_order"))


@query("W13", D.with_ctes(_STATE, body="""
, i AS (SELECT target_id, gap_id, arg_min(stage || basis, epoch) AS sig FROM gap_events GROUP BY ALL),
a AS (SELECT e.target_id, e.gap_id, arg_max(stage || basis, epoch) AS sig FROM gap_events e JOIN st USING (target_id, gap_id) WHERE last_open > last_close GROUP BY ALL)
SELECT i.target_id, i.gap_id, CASE WHEN a.sig IS NULL THEN 'closed' WHEN a.sig <> i.sig THEN 'followup' WHEN i.gap_id = 'g1' THEN 'retryable'
  WHEN i.gap_id = 'g2' THEN 'unavailable' ELSE 'active' END AS kind FROM i LEFT JOIN a ON a.target_id = i.target_id AND a.gap_id = i.gap_id
""".replace("\n, i AS", ", i AS", 1)))
def task_sets(t):
    """Follow-up, retryable and terminal tasks after a round."""
    e = D.gap_events(t)
    sig = F.concat("stage", "basis")
    key = ["target_id", "gap_id"]
    issued = e.groupBy(*key).agg(F.min_by(sig, "epoch").alias("signature"))
    live = S.gap_state(e).filter("state = 'open'").select(*key)
    active = e.join(live, key, "left_semi").groupBy(*key).agg(F.max_by(sig, "epoch").alias("signature"))
    feedback = issued.select(*key, F.when(F.col("gap_id") == "g1", "budget_exhausted").when(F.col("gap_id") == "g2", "unavailable").otherwise("returned").alias("status"))
    return S.task_sets(issued, active, feedback)


@query("W16", """
SELECT doc_id, greatest(0, least(least(n_chars, 1600), 20000 - (sum(least(n_chars, 1600)) OVER (PARTITION BY source ORDER BY doc_id) - least(n_chars, 1600))))::BIGINT AS allocated FROM documents""")
def prefix_allocation(t):
    """Characters per document in arrival order until the source's budget ends."""
    d = t("documents").select("doc_id", "source", "n_chars", F.floor(F.col("doc_id") / 1000).alias("block"))
    return S.capped_lengths(d, "source", "block", [F.col("doc_id")], "n_chars", 1600, 20000).select("doc_id", F.col("allocated").cast("long").alias("allocated"))


@query("W15", """
WITH w AS (SELECT doc_id, source, least(n_chars, 1600) AS want, count(*) OVER (PARTITION BY source) AS n FROM documents),
l AS (SELECT a.source, a.want, (SELECT sum(least(b.want, a.want)) FROM w b WHERE b.source = a.source) AS fill FROM (SELECT DISTINCT source, want FROM w) a),
p AS (SELECT s.source, coalesce((SELECT max(want) FROM l WHERE l.source = s.source AND fill <= 9000), -1) AS top FROM (SELECT DISTINCT source FROM w) s),
q AS (SELECT w.source, p.top, 9000 - coalesce(sum(want) FILTER (want <= top), 0) AS budget, count(*) FILTER (want > top) AS rest FROM w JOIN p ON p.source = w.source GROUP BY ALL)
SELECT doc_id, CASE WHEN want <= top THEN want ELSE (budget // rest)::BIGINT + CASE WHEN rn <= budget % rest THEN 1 ELSE 0 END END::BIGINT AS allocated
FROM (SELECT w.*, q.top, q.budget, q.rest, row_number() OVER (PARTITION BY w.source, want > q.top ORDER BY doc_id) AS rn FROM w JOIN q ON q.source = w.source)""")
def fair_allocation(t):
    """Equal character shares per source, bounded per document and in total."""
    d = t("documents").select("doc_id", "source", "n_chars", F.floor(F.col("doc_id") / 1000).alias("block"))
    return S.fair_shares(d, "source", "block", "doc_id", "n_chars", 1600, 9000).select("doc_id", "allocated")


@query("W14", """
SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 4 <> 0 THEN DATE '2024-01-01' + CAST(n_chars % 300 AS INT) END NULLS LAST, doc_id) AS position
FROM documents""")
def source_timeline(t):
    """Position of every document in its source's timeline: parseable dates first, unknown last."""
    i = F.col("doc_id")
    label = F.when(i % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 300).cast("int")).cast("string")).otherwise("unknown")
    d = t("documents").select("source", "doc_id", label.alias("label"))
    day = F.coalesce(F.to_date(F.try_to_timestamp("label", F.lit("yyyy-MM-dd"))), F.lit("9999-12-31").cast("date"))
    # the unknown dates of a source share a day, so a bucket is a block of ids within the day
    placed = d.withColumn("slot", F.struct(day.alias("day"), F.floor(i / 1000).alias("block")))
    return S.sequence_numbers(placed, ["source"], "slot", [i]).select("doc_id", F.col("sequence").alias("position"))


@query("R4 R7", """
WITH r AS (SELECT user_id AS target_id, CAST(ts AS DATE) AS day, count(*) AS received, count(*) FILTER (event_type = 'view') AS eligible, bool_or(event_type = 'purchase' AND value > 150) AS complete,
    count(*) FILTER (event_type = 'error') AS retryable FROM events GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY day) AS round, sum(received) OVER (PARTITION BY target_id ORDER BY day) AS docs FROM r),
s AS (SELECT *, CASE WHEN complete THEN 'complete' WHEN eligible = 0 AND NOT (round < 12 AND retryable > 0) THEN 'no_new_eligible_materials'
    WHEN docs >= 60 THEN 'document_budget' WHEN docs >= 90 THEN 'decomposition_budget' WHEN round >= 12 THEN 'round_budget' END AS reason FROM n)
SELECT target_id, arg_min(reason, round) FILTER (reason IS NOT NULL) AS stop_reason, min(round) FILTER (reason IS NOT NULL) AS stop_round FROM s GROUP BY target_id""")
def stop_reasons(t):
    """First stop reason per target from budgets, progress and completion."""
    e = t("events").groupBy(F.col("user_id").alias("target_id"), F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("event_type") == "view").alias("new_eligible"),
        F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 150)).alias("complete"),
        F.count_if(F.col("event_type") == "error").alias("retryable"))
    month = e.withColumn("month", F.trunc("day", "month"))
    r = S.running_sums(month, ["target_id"], "month", [F.col("day")], {"round": F.lit(1), "documents": F.col("received")})
    r = r.withColumns({"followups": F.lit(0), "has_next_round": F.col("round") < 12, "all_unavailable": F.lit(False),
                       "progress": F.when(F.col("new_eligible") > 0, "new_structure").otherwise("unchanged"),
                       "documents_left": 60 - F.col("documents"), "calls_left": 90 - F.col("documents")})
    r = r.withColumn("reason", S.stop_reason())
    stopped = F.when(F.col("reason").isNotNull(), F.col("round"))
    return r.groupBy("target_id").agg(F.min_by("reason", stopped).alias("stop_reason"), F.min(stopped).alias("stop_round"))


@query("W17", D.with_ctes(D.MATERIALS_SQL, D.TARGETS_SQL, body="""
, sc AS (SELECT target_id, version_id, available_at <= as_of AS adm, doc_id FROM targets JOIN materials USING (pool_id)),
g AS (SELECT *, target_id || ':missing-scope:' || substr(sha256(version_id), 1, 20) AS gap_id FROM sc)
SELECT target_id, version_id, gap_id, 'open' AS op FROM g WHERE NOT coalesce(adm, false)
UNION ALL SELECT target_id, version_id, gap_id, 'close' FROM g WHERE adm AND doc_id % 2 = 0""".replace("\n, sc AS", ", sc AS", 1)))
def scope_tasks(t):
    """Tasks for scoped versions that are missing, and closure of those that returned."""
    rows = D.targets(t).join(D.materials(t).drop("content"), "pool_id")
    admitted = rows.filter("available_at <= as_of").select("target_id", "version_id")
    gap = F.concat_ws(":", "target_id", F.lit("missing-scope"), F.substring(F.sha2("version_id", 256), 1, 20))
    scope = rows.select("target_id", "version_id")
    prior = scope.withColumn("gap_id", gap)
    receipts = rows.filter("doc_id % 2 = 0").select("target_id", "version_id").withColumn("gap_id", gap)
    return S.scope_tasks(scope, admitted, receipts, prior)


@query("W18", D.with_ctes(D.MATERIALS_SQL, body="""
, r AS (SELECT 't' || pool_id AS target_id, version_id, url, doc_id FROM materials),
x AS (SELECT target_id, version_id, 'gx' || (doc_id % 4) AS gap_id FROM r WHERE doc_id % 3 = 0),
g AS (SELECT 't' || pool_id AS target_id, 'g' || doc_id AS gap_id, CASE WHEN doc_id % 2 = 0 THEN url ELSE version_id END AS locator,
  CASE WHEN doc_id % 5 = 0 THEN version_id END AS basis_version FROM materials WHERE doc_id % 4 = 1 OR doc_id % 6 = 2 OR doc_id % 5 = 0),
l AS (SELECT DISTINCT r.target_id, r.version_id, g.gap_id FROM r JOIN g ON g.target_id = r.target_id AND (g.locator = r.version_id OR g.locator = r.url OR g.basis_version = r.version_id)
  WHERE r.doc_id % 3 <> 0)
SELECT *, 'exact' AS attribution FROM x UNION ALL SELECT *, 'heuristic' FROM l
UNION ALL SELECT target_id, version_id, NULL, 'unattributed' FROM r WHERE version_id NOT IN (SELECT version_id FROM x) AND version_id NOT IN (SELECT version_id FROM l)
""".replace("\n, r AS", ", r AS", 1)))
def attributed_feedback(t):
    """Which task a returned version answers, exact or by locator or basis."""
    m = D.materials(t).withColumn("target_id", F.concat(F.lit("t"), "pool_id"))
    i = F.col("doc_id")
    returns = m.select("target_id", "version_id", "url")
    receipts = m.filter(i % 3 == 0).select("target_id", "version_id", F.concat(F.lit("gx"), (i % 4).cast("string")).alias("gap_id"))
    gaps = m.filter((i % 4 == 1) | (i % 6 == 2) | (i % 5 == 0)).select(
        "target_id", F.concat(F.lit("g"), i).alias("gap_id"), F.when(i % 2 == 0, F.col("url")).otherwise(F.col("version_id")).alias("locator"),
        F.when(i % 5 == 0, F.col("version_id")).alias("basis_version"))
    return S.attributed_feedback(returns, receipts, gaps)
