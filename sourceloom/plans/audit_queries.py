"""Span, output, packet, log and dataset audits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.let import let
from ..functions.text import norm_ws
from ..operators import admission as A
from ..operators import audits as U
from . import derive as D
from .registry import query


def _spans(t):
    """A span at the start and one in the middle of every document; every fifth one is shifted by a character."""
    i = F.col("doc_id")
    d = t("documents").select("doc_id", "text").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    start = F.col("j") * F.floor(F.length("text") / 2) + i % 7
    shift = F.when((i + F.col("j")) % 5 == 0, 1).otherwise(0)
    return d.select(
        i.alias("finding_id"), "j", D.vid(i).alias("version_id"), (start + shift).cast("int").alias("start"), (start + shift + 15).cast("int").alias("end"),
        F.col("text").substr((start + 1).cast("int"), F.lit(15)).alias("quote"))


_SPANS = """sp AS (SELECT doc_id AS finding_id, 'v' || doc_id AS version_id, j, j * (length(text) // 2) + doc_id % 7 + CASE WHEN (doc_id + j) % 5 = 0 THEN 1 ELSE 0 END AS s,
    substr(text, j * (length(text) // 2) + doc_id % 7 + 1, 15) AS quote, text FROM documents, (VALUES (0), (1)) v(j)),
ck AS (SELECT *, s + 15 <= length(text) AND substr(text, s + 1, 15) = quote AS ok FROM sp)"""


@query("F7 J5", f"WITH {_SPANS} SELECT finding_id, s::BIGINT AS start, ok AS span_ok FROM ck")
def span_checks(t):
    """Offsets against the stored text."""
    out = U.check_spans(_spans(t), D.materials(t))
    return out.select("finding_id", F.col("start").cast("long").alias("start"), "span_ok")


@query("F8", f"""WITH {_SPANS} SELECT finding_id, count(*) AS spans, concat_ws(',', CASE WHEN NOT bool_and(ok) THEN 'invalid_span' END,
  CASE WHEN finding_id % 6 = 0 THEN 'no_span_from_side' END) AS reasons FROM ck GROUP BY finding_id""")
def basis_rules(t):
    """At least one span, all valid, one from the named side."""
    i = F.col("doc_id")
    findings = t("documents").select(i.alias("finding_id"), F.when(i % 6 == 0, "other").otherwise(D.vid(i)).alias("side"))
    out = U.basis_codes(findings, U.check_spans(_spans(t), D.materials(t)), "side")
    return out.select("finding_id", "spans", F.array_join("reasons", ",").alias("reasons"))


_QUOTE = "substr(text, 2 + length(text) // 3, 3 + doc_id % 12)"


@query("F9 X1", f"""
SELECT doc_id, CASE WHEN q = '' THEN -1 ELSE instr(text, q) - 1 END AS start, q <> '' AND instr(text, q) > 0 AND instr(substr(text, instr(text, q) + 1), q) = 0 AS once
FROM (SELECT doc_id, text, {_QUOTE} AS q FROM documents)""")
def unique_quotes(t):
    """Zero-based offset of a quote and whether it occurs exactly once, overlaps counted."""
    i = F.col("doc_id")
    q = F.col("text").substr((2 + F.floor(F.length("text") / 3)).cast("int"), (3 + i % 12).cast("int"))
    return t("documents").select("doc_id", S.first_index(q, F.col("text")).cast("long").alias("start"), S.occurs_once(q, F.col("text")).alias("once"))


@query("F10 N10", """
WITH b AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n FROM documents),
q AS (SELECT doc_id, n, trim(substr(n, 1 + length(n) // 4, 70)) AS q FROM b),
k AS (SELECT doc_id, q, instr(substr(n, instr(n, q) + 1), q) = 0 AS once FROM q)
SELECT doc_id, CASE WHEN q <> '' AND once THEN q END AS recovered FROM k""")
def quote_recovery(t):
    """Source text of a quote whose line breaks and runs of spaces were changed by the writer."""
    x = F.col("text")
    quote = F.replace(F.trim(let(norm_ws(x), lambda n: n.substr((1 + F.floor(F.length(n) / 4)).cast("int"), F.lit(70)))), F.lit(" "), F.lit("\n "))
    return t("documents").select("doc_id", "text").select("doc_id", norm_ws(S.recovered_text(quote, x)).alias("recovered"))


@query("F11", f"""WITH {_SPANS} SELECT finding_id, j::BIGINT AS j, CASE WHEN ok THEN s
  WHEN quote <> '' AND instr(text, quote) > 0 AND instr(substr(text, instr(text, quote) + 1), quote) = 0 THEN instr(text, quote) - 1 END::BIGINT AS start FROM ck""")
def offset_repair(t):
    """Given offsets when valid, else those of the verbatim unique quote."""
    rows = _spans(t).join(D.materials(t).select("version_id", "content"), "version_id")
    fixed = S.repaired_start(F.col("start"), F.col("end"), F.col("quote"), F.col("content"))
    return rows.select("finding_id", F.col("j").cast("long").alias("j"), fixed.cast("long").alias("start"))


@query("F12", """
SELECT doc_id, CASE WHEN q <> '' AND instr(p, q) > 0 AND instr(substr(p, instr(p, q) + 1), q) = 0 THEN instr(p, q) - 1 END AS qualifier_offset
FROM (SELECT doc_id, text AS p, substr(text, 1 + length(text) // 2, 2 + doc_id % 5) AS q FROM documents)""")
def qualifier_spans(t):
    """Qualifier located once inside its parent quote."""
    i, x = F.col("doc_id"), F.col("text")
    q = x.substr((1 + F.floor(F.length(x) / 2)).cast("int"), (2 + i % 5).cast("int"))
    return t("documents").select("doc_id", S.qualifier_offset(x, q).cast("long").alias("qualifier_offset"))


@query("X12", """
WITH q AS (SELECT doc_id, text, substr(text, 1 + length(text) // 3, 12) AS a,
    CASE WHEN doc_id % 2 = 0 THEN ltrim(substr(text, 13 + length(text) // 3, 12)) ELSE substr(text, 30 + length(text) // 3, 12) END AS b FROM documents),
k AS (SELECT *, instr(text, a) AS pa, instr(text, b) AS pb FROM q)
SELECT doc_id, coalesce(a <> '' AND b <> '' AND pb > 0 AND instr(substr(text, pa + 1), a) = 0 AND instr(substr(text, pb + 1), b) = 0
  AND pb - pa - length(a) BETWEEN 0 AND 8 AND trim(replace(substr(text, pa + length(a), pb - pa - length(a)), chr(10), '')) = '', false) AS adjacent FROM k""")
def adjacent_quotes(t):
    """Two unique quotes with nothing but a little whitespace between them."""
    x = F.col("text")
    part = lambda skip: x.substr((skip + F.floor(F.length(x) / 3)).cast("int"), F.lit(12))
    b = F.when(F.col("doc_id") % 2 == 0, F.ltrim(part(13))).otherwise(part(30))
    return t("documents").select("doc_id", F.coalesce(S.adjacent_quotes(part(1), b, x), F.lit(False)).alias("adjacent"))


_CITE = D.MATERIALS_SQL + f""", m AS (SELECT *, {D.ELIGIBILITY_SQL} = '' AS eligible FROM (SELECT *, 1705500000 AS as_of FROM materials)),
sp AS (SELECT doc_id AS o, CASE WHEN doc_id % 23 = 0 THEN 'v?' ELSE version_id END AS version_id, substr(content, 1 + j * (length(content) // 2), 8 + j * 20) AS quote, j,
    CASE WHEN j = 1 THEN length(content) // 2 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END END AS st FROM materials, (VALUES (0), (1)) v(j) WHERE doc_id % 10 <> 0),
ck AS (SELECT sp.*, coalesce(instr(content, quote) > 0 AND quote <> '', false) AS exact,
    coalesce(quote <> '' AND instr(content, quote) > 0 AND instr(substr(content, instr(content, quote) + 1), quote) = 0, false) AS uniq, coalesce(eligible, false) AS elig,
    CASE WHEN st IS NULL THEN true ELSE coalesce(quote <> '' AND st = instr(content, quote) - 1, false) END AS off FROM sp LEFT JOIN m ON m.version_id = sp.version_id),
ag AS (SELECT o, count(*) AS spans, count(*) FILTER (exact) AS exact, count(*) FILTER (uniq) AS uniq, count(*) FILTER (elig) AS elig, count(*) FILTER (off) AS off,
    bool_and(uniq AND elig AND off) AS good FROM ck GROUP BY o)"""


@query("F13", D.with_ctes(_CITE, body="""
SELECT d.doc_id AS output_id, coalesce(spans, 0) AS spans, coalesce(exact, 0) AS exact, coalesce(uniq, 0) AS "unique", coalesce(elig, 0) AS eligible, coalesce(off, 0) AS offsets_valid,
  d.doc_id % 29 <> 0 AND CASE WHEN spans IS NULL THEN d.doc_id % 20 = 0 ELSE good END AS passed FROM documents d LEFT JOIN ag ON o = d.doc_id"""))
def citation_audit(t):
    """Exact, unique, eligible and offset-valid citations per output."""
    i, m = F.col("doc_id"), D.materials(t)
    pool = A.with_eligibility(m.withColumn("as_of", D.ts(F.lit(1705500000)))).select("version_id", "content", (F.size("reasons") == 0).alias("eligible"))
    rows = m.filter(i % 10 != 0).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    j = F.col("j")
    middle = F.floor(F.length("content") / 2).cast("int")
    quote = F.col("content").substr(1 + j * middle, 8 + j * 20)
    start = F.when(j == 1, middle + F.when(i % 4 == 0, 1).otherwise(0))
    spans = rows.select(i.alias("output_id"), F.when(i % 23 == 0, "v?").otherwise(F.col("version_id")).alias("version_id"), quote.alias("quote"),
                        start.alias("start"), (start + F.length(quote)).alias("end"))
    outputs = m.select(i.alias("output_id"), F.when(i % 20 == 0, "unresolved").otherwise("supported").alias("verdict"),
                       F.when(i % 20 == 0, "unresolved").otherwise("supported").alias("visible_verdict"), F.when(i % 29 == 0, " ").otherwise("because").alias("rationale"))
    return U.citation_audit(outputs, spans, pool)


def _raw_output(i):
    """JSON outputs with defects by document number."""
    q = F.lit('"')
    verdict = F.when(i % 7 == 0, "maybe").otherwise("supported")
    span = F.when(i % 5 == 0, F.lit('{"version_id":"v1","quote":"q","page":3}')).when(i % 5 == 1, F.lit('{"version_id":"v1"}')).otherwise(
        F.lit('{"version_id":"v1","quote":"q","start":1}'))
    extra = F.when(i % 11 == 0, F.lit(',"note":"x"')).otherwise(F.lit(""))
    loop = F.when(i % 2 == 0, F.concat(F.lit(',"gaps":[],"resolutions":[],"round":'), F.when(i % 6 == 0, "-1").otherwise("2"))).otherwise(F.lit(""))
    rationale = F.when(i % 13 == 0, F.lit("5")).otherwise(F.lit('"r"'))
    return F.concat(F.lit('{"verdict":"'), verdict, q, F.lit(',"basis":['), span, F.lit('],"rationale":'), rationale, loop, extra, F.lit("}"))


@query("F14", """
SELECT doc_id, NOT (doc_id % 7 = 0 OR doc_id % 5 IN (0, 1) OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 6 = 0) AS shape_ok FROM documents""")
def output_shapes(t):
    """Strict shape of raw outputs for both arms."""
    i = F.col("doc_id")
    return t("documents").select("doc_id", U.output_shape_ok(_raw_output(i), i % 2 == 0).alias("shape_ok"))


_SCHEMA = {"type": "object", "properties": {
    "kind": {"type": "string", "enum": ["click", "view", "purchase", "signup"]}, "value": {"type": "number", "minimum": 0, "maximum": 50},
    "tags": {"type": "array", "maxItems": 2, "items": {"enum": ["a", "b"]}}, "who": {"type": "object", "properties": {"id": {"type": "integer"}}}}}


@query("F15", """
SELECT event_id, concat_ws(',', CASE WHEN event_id % 9 = 0 THEN '$:missing_field' END, CASE WHEN event_id % 10 = 0 THEN '$:unknown_field' END,
  CASE WHEN event_type = 'error' THEN '$.kind:enum' END, CASE WHEN event_id % 9 <> 0 AND value > 50 THEN '$.value:maximum' END,
  CASE WHEN event_id % 4 = 3 THEN '$.tags:maxItems' END, CASE WHEN event_id % 4 = 2 THEN '$.tags[]:enum' END,
  CASE WHEN event_id % 8 = 0 THEN '$.who.id:type' END) AS reasons FROM events""")
def record_conformance(t):
    """Raw records against a closed record description, all findings with their paths."""
    i = F.col("event_id")
    tags = D.pick(i % 4, "[]", '["a"]', '["a","z"]', '["a","b","a"]')
    raw = F.concat(F.lit('{"kind":"'), "event_type", F.lit('"'),
                   F.when(i % 9 == 0, F.lit("")).otherwise(F.concat(F.lit(',"value":'), F.col("value").cast("string"))),
                   F.lit(',"tags":'), tags, F.lit(',"who":{"id":'), F.when(i % 8 == 0, F.lit('"x"')).otherwise(F.col("user_id").cast("string")), F.lit("}"),
                   F.when(i % 10 == 0, F.lit(',"more":1')).otherwise(F.lit("")), F.lit("}"))
    return t("events").select("event_id", F.array_join(U.conform_codes(raw, _SCHEMA), ",").alias("reasons"))


@query("F16", """
WITH g AS (SELECT event_id, k, CASE k % 5 WHEN 0 THEN 'provenance' WHEN 4 THEN 'other' ELSE 'verification' END AS stage, ['auto','provenance','evidence','world'][(k % 4) + 1] AS dim,
  k % 3 = 0 AS blocking, ['fetch','search','reanalyse'][(k % 3) + 1] AS action, k % 7 = 0 AS noloc, k % 2 = 0 AS impact, k % 6 AS basis
  FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))
SELECT event_id, concat_ws(',', CASE WHEN stage = 'other' THEN 'invalid_stage' END,
  CASE WHEN dim <> 'auto' AND (dim = 'provenance') <> (stage = 'provenance') THEN 'stage_dimension_disagree' END,
  CASE WHEN action IN ('fetch', 'reanalyse') AND noloc THEN 'missing_locator' END,
  CASE WHEN dim IN ('evidence', 'world') AND blocking AND NOT impact THEN 'missing_decision_impact' END,
  CASE WHEN dim IN ('evidence', 'world') AND blocking AND basis = 0 THEN 'missing_basis' END) AS reasons FROM g""")
def gap_validity(t):
    """Reason codes of gap rows."""
    k = F.get_json_object("props", "$.k").cast("long")
    g = t("events").select(
        "event_id", F.lit("g").alias("gap_id"), F.lit("why").alias("question"),
        F.when(k % 5 == 0, "provenance").when(k % 5 == 4, "other").otherwise("verification").alias("stage"),
        D.pick(k % 4, "auto", "provenance", "evidence", "world").alias("dimension"), (k % 3 == 0).alias("blocking"),
        D.pick(k % 3, "fetch", "search", "reanalyse").alias("action"), F.when(k % 7 != 0, "here").alias("locator"),
        F.lit(None).cast("string").alias("probe_id"), F.when(k % 2 == 0, "matters").alias("decision_impact"), (k % 6).alias("basis_count"))
    return g.select("event_id", F.array_join(A.gap_codes(), ",").alias("reasons"))


@query("F20", """
SELECT event_id, concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'gold' END, CASE WHEN event_id % 5 = 0 THEN 'verdict' END) AS keys FROM events""")
def leak_keys(t):
    """Forbidden answer keys at any depth of the raw record."""
    i = F.col("event_id")
    raw = F.concat(F.lit('{"props":'), "props", F.lit(',"note":"the \\"gold\\" standard: none"'),
                   F.when(i % 7 == 0, F.lit(',"deep":{"list":[{"Gold" : 1}]}')).otherwise(F.lit("")),
                   F.when(i % 5 == 0, F.lit(',"verdict":"x"')).otherwise(F.lit("")), F.lit("}"))
    return t("events").select("event_id", F.array_join(U.leaked_keys(raw), ",").alias("keys"))


@query("F21", """
SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 1997 THEN year(o_orderdate)::VARCHAR ELSE '' END AS years FROM orders""")
def leak_years(t):
    """Years after the cutoff in visible text; the retrieval time is exempt."""
    raw = F.concat(F.lit('{"text":"order of '), F.year("o_orderdate"), F.lit(' for 120250 units","retrieved_at":"2026-01-01T00:00:00Z"}'))
    return t("orders").select("o_orderkey", F.array_join(U.leaked_years(raw, 1997).cast("array<string>"), ",").alias("years"))


@query("F23", D.with_ctes(D.CASES_SQL, body="SELECT id, id % 5 <> 0 AND id % 7 <> 0 AS valid FROM cases"))
def probability_validity(t):
    """Exactly four labels, values in range, sum one."""
    i = F.col("id")
    rows = D.cases(t)
    p = [F.lit(x) if j % 2 == 0 else x for j, x in enumerate(v for l in D.LABELS for v in (l, F.col(f"p_{l}")))]
    full = F.create_map(*p)
    wrong = F.map_filter(full, lambda k, v: k != "disputed")
    above = F.transform_values(full, lambda k, v: v * 1.1)
    return rows.select("id", A.valid_probabilities(F.when(i % 5 == 0, wrong).when(i % 7 == 0, above).otherwise(full)).alias("valid"))


@query("F24", """
WITH e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events),
r AS (SELECT event_id AS i, CASE event_type WHEN 'click' THEN 'source_attribution' WHEN 'purchase' THEN 'real_world_provenance' WHEN 'error' THEN 'real_world_provenance' ELSE 'other_factual' END AS scope,
  CASE WHEN value < 25 THEN 'supported' WHEN value < 50 THEN 'contradicted' WHEN value < 100 THEN 'conflicting' ELSE 'unresolved' END AS v,
  CASE WHEN k >= 60 THEN 'high' ELSE 'low' END AS risk, hour(ts) >= 12 AS auth, k // 10 AS ev FROM e)
SELECT i AS event_id, concat_ws(',', CASE WHEN v IN ('supported', 'contradicted') AND ev = 0 THEN 'settled_needs_evidence' END,
  CASE WHEN scope = 'real_world_provenance' AND NOT auth AND NOT (v = 'unresolved' AND risk = 'high') THEN 'unauthenticated_must_stay_open' END,
  CASE WHEN scope = 'source_attribution' AND v = 'supported' AND risk <> 'low' THEN 'attribution_must_be_low_risk' END) AS reasons FROM r""")
def risk_invariants(t):
    """Invariants between claim scope, verdict, authentication and risk."""
    kind, value, k = F.col("event_type"), F.col("value"), F.regexp_extract("props", "[0-9]+", 0).cast("int")
    r = t("events").select(
        "event_id", F.when(kind == "click", "source_attribution").when(kind.isin("purchase", "error"), "real_world_provenance").otherwise("other_factual").alias("claim_scope"),
        F.when(value < 25, "supported").when(value < 50, "contradicted").when(value < 100, "conflicting").otherwise("unresolved").alias("fact_verdict"),
        F.when(k >= 60, "high").otherwise("low").alias("fraud_risk"), (F.hour("ts") >= 12).alias("independent_authentication"),
        F.floor(k / 10).alias("evidence_count"))
    return r.select("event_id", F.array_join(A.risk_codes(), ",").alias("reasons"))


@query("F25 F26", D.with_ctes(D.GAP_EVENTS_SQL, body="""
, o AS (SELECT target_id, gap_id, arg_max(op, epoch) AS op, arg_max(blocking, epoch) AS blocking, arg_max(stage, epoch) AS stage FROM gap_events GROUP BY ALL),
b AS (SELECT target_id, count(*) AS n FROM o WHERE op = 'open' AND blocking AND stage = 'verification' GROUP BY target_id),
t AS (SELECT DISTINCT user_id, 'u' || user_id AS target_id FROM events)
SELECT t.target_id, d AS dimension, CASE WHEN d = 'world' THEN coalesce(n, 0) ELSE 0 END AS blocking_gaps, CASE WHEN d = 'world' AND n > 0 THEN 'unresolved' ELSE 'supported' END AS decision,
  CASE WHEN user_id % 6 = 0 THEN 'unverifiable' WHEN d = 'world' AND n > 0 THEN 'unverifiable' ELSE 'true' END AS label
FROM t LEFT JOIN b ON b.target_id = t.target_id, (VALUES ('evidence'), ('world')) v(d)""".replace("\n, o AS", ", o AS", 1)))
def blocking_mask(t):
    """A blocking gap makes only its own dimension unresolved; then the presented label."""
    g = D.gap_events(t)
    last = g.groupBy("target_id", "gap_id").agg(*[F.max_by(c, "epoch").alias(c) for c in ("op", "blocking", "stage")])
    active = last.filter("op = 'open'").withColumn("dimension", F.lit("auto"))
    users = t("events").select("user_id").distinct()
    verdicts = users.select("user_id", F.concat(F.lit("u"), "user_id").alias("target_id"), F.lit("supported").alias("verdict"),
                            F.explode(F.array(F.lit("evidence"), F.lit("world"))).alias("dimension"))
    out = A.mask_blocked(verdicts, active)
    return out.select("target_id", "dimension", "blocking_gaps", "decision", A.decision_label(F.col("decision"), F.col("user_id") % 6 != 0).alias("label"))


_CAP = """cap AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'view' THEN '200' WHEN event_type = 'click' THEN '301' WHEN event_type = 'error' THEN '404' ELSE '302' END AS status,
  CASE WHEN event_id % 40 = 0 THEN 'n/a' ELSE strftime(ts, '%Y%m%d%H%M%S') END AS stamp FROM events)"""


def _captures(t):
    e, i = t("events"), F.col("event_id")
    return e.select(
        i, F.col("user_id").alias("url"), F.when(F.col("event_type") == "view", "200").when(F.col("event_type") == "click", "301")
        .when(F.col("event_type") == "error", "404").otherwise("302").alias("statuscode"),
        F.when(i % 40 == 0, "n/a").otherwise(F.date_format("ts", "yyyyMMddHHmmss")).alias("timestamp"))


@query("F27", f"WITH {_CAP} SELECT event_id FROM cap WHERE status <> '404' AND stamp <> 'n/a' AND stamp <= '20240120000000'")
def usable_captures(t):
    """Captures with a served status and a stamp at or before the cutoff."""
    return A.usable_captures(_captures(t), F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("J4 F27", f"""WITH {_CAP}, u AS (SELECT * FROM cap WHERE status <> '404' AND stamp <> 'n/a' AND stamp <= '20240120000000')
SELECT user_id AS url, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (status = '200') DESC, stamp DESC, event_id DESC) AS rank FROM u) WHERE rank <= 3""")
def as_of_version(t):
    """Best captures at the cutoff per address: status 200 first, then latest; three fallbacks."""
    from ..operators.skew import top_k
    ok = A.usable_captures(_captures(t), F.lit("2024-01-20").cast("timestamp"))
    out = top_k(ok, ["url"], [(F.col("statuscode") == "200").desc(), F.col("timestamp").desc(), F.col("event_id").desc()], 3)
    return out.select("url", "event_id", F.col("rank").cast("long").alias("rank"))


@query("F28", """
SELECT page_id, concat_ws(',', CASE WHEN page_id % 6 = 0 THEN 'non_archive_address' END, CASE WHEN page_id % 6 = 0 THEN 'invalid_archive_timestamp' END,
  CASE WHEN page_id % 6 <> 0 AND page_id % 7 = 0 THEN 'post_cutoff_capture' END, CASE WHEN page_id % 6 = 0 OR page_id % 5 = 0 THEN 'timestamp_mismatch' END,
  CASE WHEN page_id % 6 = 0 OR page_id % 4 = 1 THEN 'identity_mismatch' END, CASE WHEN page_id % 9 = 0 THEN 'digest_mismatch' END) AS reasons FROM pages""")
def replay_identity(t):
    """Archived pages: stamp, header time, address, digest and size agree."""
    i = F.col("page_id")
    stamp = F.when(i % 7 == 0, "20240301000000").otherwise("20240101120000")
    original = F.concat(F.lit("https://site.example.org/p"), i)
    at = F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss"))
    rows = t("pages").select(
        i, F.concat(F.when(i % 6 == 0, "https://elsewhere.example.org/web/").otherwise("https://web.archive.org/web/"), stamp, F.lit("id_/"), original).alias("archive_url"),
        F.when(i % 5 == 0, F.timestamp_add("SECOND", F.lit(1), at)).otherwise(at).alias("header_time"), F.lit("2024-02-01").cast("timestamp").alias("cutoff"),
        F.when(i % 4 == 1, "https://site.example.org/other").otherwise(original).alias("final_url"), F.col("html").alias("body"),
        F.when(i % 9 == 0, "00").otherwise(F.sha2("html", 256)).alias("sha256"), F.octet_length("html").alias("decoded_bytes"))
    return rows.select("page_id", F.array_join(A.replay_codes(), ",").alias("reasons"))


@query("F35", D.with_ctes(D.GAP_EVENTS_SQL, body="""
, c AS (SELECT *, CASE WHEN epoch % 13 = 0 THEN 'g?' ELSE gap_id END AS g FROM gap_events WHERE op = 'close'),
g AS (SELECT target_id, gap_id, any_value(stage) AS stage FROM gap_events GROUP BY ALL),
r AS (SELECT DISTINCT target_id, gap_id, basis FROM gap_events WHERE op = 'open')
SELECT epoch, concat_ws(',', CASE WHEN g.stage IS NULL THEN 'unknown_gap' END, CASE WHEN epoch % 2 = 0 AND g.stage = 'provenance' THEN 'verifier_closes_provenance' END,
  CASE WHEN r.basis IS NULL THEN 'basis_not_attributed' END) AS reasons
FROM c LEFT JOIN g ON g.target_id = c.target_id AND g.gap_id = c.g LEFT JOIN r ON r.target_id = c.target_id AND r.gap_id = c.g AND r.basis = c.basis""".replace("\n, c AS", ", c AS", 1)))
def closure_checks(t):
    """Closures of known gaps, in their stage, resting on an attributed return."""
    e = D.gap_events(t)
    closures = e.filter("op = 'close'").select(
        "target_id", F.when(F.col("epoch") % 13 == 0, "g?").otherwise(F.col("gap_id")).alias("gap_id"), "epoch",
        F.when(F.col("epoch") % 2 == 0, "verification").otherwise("decomposition").alias("closed_by"), F.col("basis").alias("basis_version"))
    gaps = e.groupBy("target_id", "gap_id").agg(F.any_value("stage").alias("stage")).withColumn("dimension", F.lit("auto"))
    receipts = e.filter("op = 'open'").select("target_id", "gap_id", F.col("basis").alias("version_id"))
    return A.closure_codes(closures, gaps, receipts).select("epoch", F.array_join("reasons", ",").alias("reasons"))


@query("F36", D.with_ctes(D.GAP_EVENTS_SQL, body="""
, f AS (SELECT target_id, gap_id, arg_min(owner, epoch) AS owner, arg_max(op, epoch) AS last_op FROM gap_events GROUP BY ALL),
act AS (SELECT target_id, gap_id, owner FROM f WHERE gap_id <> 'g3'),
nw AS (SELECT target_id, gap_id, CASE WHEN CAST(substr(target_id, 2) AS BIGINT) % 2 = 0 THEN owner ELSE 'ownerX' END AS owner FROM f WHERE gap_id IN ('g0', 'g3')
  UNION ALL SELECT target_id, 'origin:' || target_id, 'ownerX' FROM f WHERE gap_id = 'g0'),
pr AS (SELECT target_id, gap_id, owner FROM f), rs AS (SELECT target_id, gap_id FROM f WHERE last_op = 'close')
SELECT target_id, gap_id, owner, 'new' AS kind FROM nw WHERE gap_id NOT LIKE 'origin:%' AND NOT EXISTS (SELECT 1 FROM act a WHERE a.target_id = nw.target_id AND a.gap_id = nw.gap_id AND a.owner <> nw.owner)
UNION ALL SELECT target_id, gap_id, owner, 'carried' FROM pr WHERE (target_id, gap_id) IN (SELECT target_id, gap_id FROM act) AND (target_id, gap_id) NOT IN (SELECT target_id, gap_id FROM rs)
  AND (target_id, gap_id) NOT IN (SELECT target_id, gap_id FROM nw)""".replace("\n, f AS", ", f AS", 1)))
def gap_cleanup(t):
    """New gaps without reserved and restated ids, plus carried open gaps."""
    f = D.gap_events(t).groupBy("target_id", "gap_id").agg(F.min_by("owner", "epoch").alias("owner"), F.max_by("op", "epoch").alias("last_op"))
    active = f.filter("gap_id <> 'g3'").select("target_id", "gap_id", "owner")
    even = F.substring("target_id", 2, 20).cast("long") % 2 == 0
    new = f.filter("gap_id IN ('g0', 'g3')").select("target_id", "gap_id", F.when(even, F.col("owner")).otherwise("ownerX").alias("owner")).unionByName(
        f.filter("gap_id = 'g0'").select("target_id", F.concat(F.lit("origin:"), "target_id").alias("gap_id"), F.lit("ownerX").alias("owner")))
    return A.clean_gap_batch(new, active, f, f.filter("last_op = 'close'"))


@query("F39", """
SELECT doc_id, trim(substr(text, 1, 500)) AS body, length(text) > 500 AS cut, array_to_string(list_distinct_ordered, ',') AS tags, len(tags) > 6 AS tags_cut
FROM (SELECT doc_id, text, string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') AS tags FROM documents) d,
LATERAL (SELECT list(x ORDER BY p) AS list_distinct_ordered FROM (SELECT x, min(p) AS p FROM (SELECT trim(tags[p]) AS x, p FROM range(1, 7) r(p) WHERE p <= len(tags)) WHERE x <> '' GROUP BY x)) q""")
def bounded_fields(t):
    """Bounded text and list fields with truncation flags."""
    # as in SQL: letter by letter, so no sigma depends on its neighbours, and no vertical tab among the blanks
    low = F.lower(F.translate("text", "\u0130\u03a3", "i\u03c3"))
    tags = F.split(F.regexp_replace(low, r"[\t\n\f\r ]+", " "), " ")
    body, cut = A.bounded_text(F.col("text"), 500)
    items, tags_cut = A.bounded_list(tags, 6)
    joined = F.when(F.size(items) > 0, F.array_join(items, ","))  # a blank text has no tags
    return t("documents").select("doc_id", body.alias("body"), cut.alias("cut"), joined.alias("tags"), tags_cut.alias("tags_cut"))


@query("F41", """
WITH p AS (SELECT doc_id, source, n_chars, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT *, coalesce(w[len(w) // 3 + 1], '') AS a, coalesce(w[2 * len(w) // 3 + 1], '') AS b, list_slice(w, len(w) // 2 + 1, len(w) // 2 + 6) AS lead FROM p),
r AS (SELECT *, ['fetch', 'reanalyse', 'search'][n_chars % 3 + 1] AS action, 'see https://' || source || '.example.org/' || a || ' now' AS basis,
  CASE WHEN length(b) > 4 THEN 'https://' || source || '.example.org' ELSE '' END || '/' || substr(b, 1, 1) AS locator,
  list_filter([a, b], lambda x: x <> '' AND x NOT IN ('the','and','that','this','with','from','before','after','until','has','have','had','was','were','will')) AS probe FROM q)
SELECT doc_id, concat_ws(',', CASE WHEN action = 'fetch' AND NOT regexp_matches(locator, '^https?://[^/?#]+') THEN 'locator_not_absolute' END,
  CASE WHEN action = 'fetch' AND length(a) = length(b) THEN 'visible_url_needs_reanalysis' END, CASE WHEN action = 'fetch' AND NOT contains(basis, locator) THEN 'locator_not_in_basis' END,
  CASE WHEN action = 'reanalyse' AND n_chars < 1500 THEN 'version_not_available' END, CASE WHEN action = 'search' AND NOT list_has_any(lead, probe) THEN 'no_grounded_term' END) AS reasons FROM r""")
def task_validity(t):
    """Proposed tasks against their own context: addresses, quotes and terms come from words in the middle of each text."""
    from ..functions.text import evidence_terms
    n, w = F.size("w"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)
    word = lambda k: F.coalesce(F.get("w", F.floor(n * k / 3).cast("int")), F.lit(""))
    rows = t("documents").filter("text IS NOT NULL").withColumn("w", w).withColumns({"a": word(1), "b": word(2)})
    host = F.concat(F.lit("https://"), "source", F.lit(".example.org"))
    lead = F.concat_ws(" ", F.slice("w", F.floor(n / 2).cast("int") + 1, 6))
    rows = rows.select(
        "doc_id", D.pick(F.col("n_chars") % 3, "fetch", "reanalyse", "search").alias("action"),
        F.concat(F.when(F.length("b") > 4, host).otherwise(""), F.lit("/"), F.substring("b", 1, 1)).alias("locator"),
        F.concat(F.lit("see "), host, F.lit("/"), "a", F.lit(" now")).alias("basis_quote"),
        evidence_terms(F.concat_ws(" ", "a", "b")).alias("probe_terms"), evidence_terms(lead).alias("lead_terms"),
        (F.length("a") == F.length("b")).alias("url_visible"), (F.col("n_chars") >= 1500).alias("version_available"))
    return rows.select("doc_id", F.array_join(A.task_codes(), ",").alias("reasons"))


@query("F42", """
WITH c AS (SELECT doc_id, doc_id % 3 AS j, 'v' || doc_id AS v, trim(substr(text, length(text) // 2 + 1, 60)) AS quote, CASE WHEN doc_id % 5 = 0 THEN 'v' || doc_id ELSE trim(substr(text, length(text) // 2 + 5, 9)) END AS locator, text FROM documents)
SELECT doc_id AS citation_id, concat_ws(',', CASE WHEN NOT contains(quote, locator) THEN 'locator_not_in_quote' END,
  CASE WHEN NOT (quote <> '' AND instr(text, quote) > 0 AND instr(substr(text, instr(text, quote) + 1), quote) = 0) THEN 'quote_not_unique' END,
  CASE WHEN doc_id % 5 = 0 THEN 'cites_itself' END, CASE WHEN doc_id % 4 = 0 THEN 'duplicate_citation' END) AS reasons FROM c
UNION ALL SELECT doc_id + 1000000000, concat_ws(',', CASE WHEN NOT contains(quote, locator) THEN 'locator_not_in_quote' END,
  CASE WHEN NOT (quote <> '' AND instr(text, quote) > 0 AND instr(substr(text, instr(text, quote) + 1), quote) = 0) THEN 'quote_not_unique' END,
  CASE WHEN doc_id % 5 = 0 THEN 'cites_itself' END, 'duplicate_citation') FROM c WHERE doc_id % 4 = 0""")
def citation_drafts(t):
    """Citation drafts: locator in quote, unique quote, not itself, no repeat."""
    i, x = F.col("doc_id"), F.col("text")
    half = F.floor(F.length("text") / 2).cast("int")
    c = t("documents").select(i.alias("citation_id"), D.vid(i).alias("version_id"), F.trim(x.substr(half + 1, F.lit(60))).alias("quote"),
                              F.when(i % 5 == 0, D.vid(i)).otherwise(F.trim(x.substr(half + 5, F.lit(9)))).alias("locator"), F.lit("cites").alias("kind"))
    again = c.filter(F.col("citation_id") % 4 == 0).withColumn("citation_id", F.col("citation_id") + 1000000000)
    return U.draft_codes(c.unionByName(again), D.materials(t)).withColumn("reasons", F.array_join("reasons", ","))


@query("F3 A34 F9", """
SELECT item_id AS quote_id, doc_id FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM benchmark) b,
  (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n FROM documents) d WHERE contains(n, q)""")
def quote_containment(t):
    """Every benchmark passage with the documents that hold it."""
    return U.contained_pairs(t("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), t("documents").select("doc_id", "text"))


@query("A34", """
WITH p AS (SELECT doc_id, source AS packet_id, doc_id % 3 AS f, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE text END AS content,
  CASE doc_id % 3 WHEN 0 THEN text || CASE WHEN doc_id % 8 = 0 THEN '!' ELSE '' END WHEN 1 THEN substr(text, 1, 800) ELSE substr(text, 1 + doc_id % 2, 120) END AS sent FROM documents),
s AS (SELECT *, CASE f WHEN 0 THEN sent = content WHEN 1 THEN sent = substr(content, 1, 800) ELSE starts_with(content, sent) AND length(sent) > 0 END AS same FROM p)
SELECT packet_id, count(*) FILTER (f = 0) AS "full", count(*) FILTER (f = 1) AS previews, count(*) FILTER (f = 2) AS excerpts, count(*) FILTER (content IS NULL) AS unregistered,
  count(*) FILTER (content IS NOT NULL AND NOT same) AS changed, bool_and(coalesce(same, false)) AS all_registered FROM s GROUP BY packet_id""")
def exposure_audit(t):
    """What each packet exposed, and whether it equals the registered pool."""
    i, x = F.col("doc_id"), F.col("text")
    d = t("documents")
    packets = d.select(F.col("source").alias("packet_id"), i.alias("version_id"), D.pick(i % 3, "full", "preview", "excerpt").alias("form"),
                       F.when(i % 3 == 0, F.concat(x, F.when(i % 8 == 0, "!").otherwise(""))).when(i % 3 == 1, F.left(x, F.lit(800)))
                       .otherwise(x.substr((1 + i % 2).cast("int"), F.lit(120))).alias("text"))
    pool = d.filter(i % 19 != 0).select(i.alias("version_id"), x.alias("content"))
    return U.packet_exposure(packets, pool)


@query("A34", """
WITH p AS (SELECT doc_id, source AS packet_id, ['full', 'preview', 'excerpt'][n_chars % 3 + 1] AS form, length(text) // 3 AS start, text,
  CASE WHEN doc_id % 19 = 0 THEN NULL ELSE text END AS content FROM documents),
s AS (SELECT *, CASE form WHEN 'full' THEN CASE WHEN start % 8 = 0 THEN text || '!' ELSE text END WHEN 'preview' THEN substr(text, 1, 800 - start % 5 // 4)
  ELSE substr(text, start + 1 + start % 2, 120) END AS sent FROM p)
SELECT DISTINCT packet_id, form, 'v' || doc_id AS version_id, CASE WHEN form = 'excerpt' THEN start END AS start, length(sent) AS characters,
  CASE WHEN form = 'excerpt' THEN sha256(sent) END AS text_sha256, coalesce(CASE form WHEN 'full' THEN sent = content WHEN 'preview' THEN sent = substr(content, 1, 800)
    ELSE sent = substr(content, start + 1, length(sent)) AND length(sent) > 0 END, false) AS registered FROM s""")
def exposure_lists(t):
    """What each packet exposed, entry by entry: full ids, preview ids, excerpts with place and hash."""
    x, s = F.col("text"), F.col("start")
    d = t("documents").withColumn("start", F.floor(F.length("text") / 3))
    sent = F.when(F.col("form") == "full", F.concat(x, F.when(s % 8 == 0, "!").otherwise(""))).when(
        F.col("form") == "preview", x.substr(F.lit(1), F.lit(800) - F.when(s % 5 == 4, 1).otherwise(0))).otherwise(
        x.substr((s + 1 + s % 2).cast("int"), F.lit(120)))
    packets = d.select(F.col("source").alias("packet_id"), D.vid(F.col("doc_id")).alias("version_id"),
                       D.pick(F.col("n_chars") % 3, "full", "preview", "excerpt").alias("form"), "start", "text").withColumn("text", sent)
    pool = t("documents").filter(F.col("doc_id") % 19 != 0).select(D.vid(F.col("doc_id")).alias("version_id"), F.col("text").alias("content"))
    return U.exposure_lists(packets, pool)


@query("A33", "SELECT lang AS stage, sha256(text) AS content_hash, count(*) AS times FROM documents GROUP BY ALL HAVING count(*) > 1")
def exposure_counts(t):
    """Versions sent more than once to one stage."""
    return U.repeated_exposures(t("documents").select(F.col("lang").alias("stage"), F.sha2("text", 256).alias("content_hash")))


@query("J15", D.with_ctes(D.MATERIALS_SQL, D.TARGETS_SQL, body="""
, s AS (SELECT target_id, pool_id, as_of, 'v' || (pool_id * 21 + 1) AS a, 'v' || (pool_id * 21 + 2) AS b FROM targets),
sc AS (SELECT target_id, a AS v FROM s UNION ALL SELECT target_id, b FROM s),
el AS (SELECT DISTINCT target_id, version_id FROM targets JOIN materials USING (pool_id) WHERE available_at <= as_of),
ci AS (SELECT target_id, source_version_id AS version_id FROM targets),
m AS (SELECT target_id, count(*) AS n FROM sc WHERE (target_id, v) NOT IN (SELECT target_id, version_id FROM el) GROUP BY target_id),
o AS (SELECT target_id, count(*) AS n FROM ci WHERE (target_id, version_id) NOT IN (SELECT target_id, v FROM sc) GROUP BY target_id)
SELECT t.target_id, coalesce(m.n, 0) AS missing, coalesce(o.n, 0) AS outside, coalesce(m.n, 0) = 0 AND coalesce(o.n, 0) = 0 AS covered
FROM targets t LEFT JOIN m ON m.target_id = t.target_id LEFT JOIN o ON o.target_id = t.target_id""".replace("\n, s AS", ", s AS", 1)))
def scope_coverage(t):
    """Scoped versions missing and citations outside the scope, per target."""
    tg = D.targets(t)
    scoped = tg.withColumn("evidence_scope", F.array(D.vid(F.col("pool_id") * 21 + 1), D.vid(F.col("pool_id") * 21 + 2)))
    eligible = tg.join(D.materials(t), "pool_id").filter("available_at <= as_of").select("target_id", "version_id")
    cited = tg.select("target_id", F.col("source_version_id").alias("version_id"))
    return U.scope_coverage(scoped, eligible, cited).select("target_id", "missing", "outside", "covered")


@query("J19", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS n FROM events),
b AS (SELECT event_id AS response_id, user_id, event_type, props, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS n FROM events WHERE value > 10)
SELECT a.event_id, b.response_id, b.response_id IS NOT NULL AS cached FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.props = b.props AND a.n = b.n""")
def response_cache_match(t):
    """Nth equal request paired with the nth logged response."""
    e = t("events").select("event_id", "user_id", "event_type", "props", "value")
    log = e.filter("value > 10").withColumn("response_id", F.col("event_id"))
    return U.cached_responses(e, log, ["user_id", "event_type", "props"], "event_id").select("event_id", "response_id", "cached")


@query("J20", """
SELECT event_id AS sequence, CASE WHEN event_id % 31 = 0 THEN 'missing_in_trace' WHEN event_id % 37 = 0 THEN 'response_differs' ELSE 'digest_differs' END AS problem
FROM events WHERE event_id % 31 = 0 OR event_id % 37 = 0 OR event_id % 41 = 0""")
def call_binding(t):
    """Trace lineage against the call log."""
    i = F.col("event_id")
    e = t("events")
    calls = e.select(F.col("user_id").alias("trace_id"), i.alias("sequence"), F.concat(F.lit("r"), i).alias("response_id"), F.col("props").alias("output"))
    lineage = e.filter(i % 31 != 0).select(F.col("user_id").alias("trace_id"), i.alias("sequence"),
                                           F.concat(F.when(i % 37 == 0, "x").otherwise("r"), i).alias("response_id"),
                                           F.sha2(F.when(i % 41 == 0, "tampered").otherwise(F.col("props")), 256).alias("output_sha256"))
    return U.call_binding(calls, lineage).select("sequence", "problem")


def _dataset(t):
    """Documents as cases of one claim and one outcome each, with planted contract violations."""
    i, x = F.col("doc_id"), F.col("text")
    d = t("documents").select("doc_id", "text", "source").withColumn("role", F.explode(F.array(F.lit("claim"), F.lit("outcome"))))
    outcome = F.col("role") == "outcome"
    version = F.concat(F.col("role"), i)
    at = F.lit(D.EPOCH) + F.when(outcome, F.when(i % 11 == 0, -5).otherwise(50)).otherwise(0) * D.HOUR + (i % 20) * D.HOUR
    url = F.concat(F.lit("https://a.example.org/"), version)
    inputs = d.select(i.alias("case_id"), version.alias("version_id"), url.alias("url"), x.alias("content"), D.ts(at).alias("published_at"), D.ts(at).alias("available_at"))
    sources = d.filter(~(outcome & (i % 17 == 0))).select(
        i.alias("case_id"), F.col("source").alias("event_id"), version.alias("version_id"), "role",
        F.when(i % 13 == 0, "https://b.example.org/").otherwise(url).alias("source_url"), F.sha2(F.when(i % 19 == 0, F.lit("x")).otherwise(x), 256).alias("content_sha256"),
        D.ts(at).alias("observed_at"), D.ts(F.lit(D.EPOCH) + F.when(i % 23 == 0, 40).otherwise(100) * D.HOUR).alias("deadline"))
    gold = d.filter(outcome & (i % 29 != 0)).select(i.alias("case_id"), F.when(i % 7 == 0, "other").otherwise(F.col("source")).alias("event_id"),
                                                     version.alias("version_id"), x.substr(1, 50).alias("quote"))
    return inputs, sources, gold


@query("J21", """
WITH d AS (SELECT doc_id AS i, text, role, 1704067200 + CASE WHEN role = 'outcome' THEN CASE WHEN doc_id % 11 = 0 THEN -5 ELSE 50 END ELSE 0 END * 3600 + (doc_id % 20) * 3600 AS pub,
    1704067200 + CASE WHEN doc_id % 23 = 0 THEN 40 ELSE 100 END * 3600 AS dl, 1704067200 + (doc_id % 20) * 3600 AS claim_at, role || doc_id AS v FROM documents, (VALUES ('claim'), ('outcome')) r(role)),
s AS (SELECT *, NOT (role = 'outcome' AND i % 17 = 0) AS has FROM d),
x AS (SELECT i, v, unnest(list_filter([CASE WHEN NOT has THEN 'no_source_metadata' END, CASE WHEN has AND i % 13 = 0 THEN 'url_mismatch' END, CASE WHEN has AND i % 19 = 0 THEN 'content_mismatch' END,
    CASE WHEN has AND pub > 1704067200 + 65 * 3600 THEN 'after_cutoff' WHEN NOT has AND pub > 1704067200 + 65 * 3600 THEN 'after_cutoff' END,
    CASE WHEN has AND role = 'outcome' AND NOT claim_at < pub THEN 'outcome_not_after_claim' END, CASE WHEN has AND role = 'outcome' AND pub > dl THEN 'after_deadline' END,
    CASE WHEN i % 17 = 0 THEN 'no_outcome' END], lambda c: c IS NOT NULL)) AS code FROM s),
g AS (SELECT i, v, unnest(list_filter([CASE WHEN NOT has THEN 'gold_cites_non_outcome' END, CASE WHEN has AND i % 7 = 0 THEN 'gold_event_mismatch' END,
    CASE WHEN NOT (q <> '' AND instr(substr(text, 2), q) = 0) THEN 'gold_quote_not_unique' END], lambda c: c IS NOT NULL)) AS code
  FROM (SELECT *, substr(text, 1, 50) AS q FROM s WHERE role = 'outcome' AND i % 29 <> 0)),
u AS (SELECT i, v, 'outcome_not_in_gold' AS code FROM s WHERE role = 'outcome' AND has AND i % 29 = 0)
SELECT code, count(*) AS violations, count(DISTINCT i) AS cases FROM (SELECT * FROM x UNION ALL SELECT * FROM g UNION ALL SELECT * FROM u) GROUP BY code""")
def dataset_contract(t):
    """Violations between inputs, source metadata and gold, by code."""
    inputs, sources, gold = _dataset(t)
    out = U.dataset_contract(inputs, sources, gold, D.ts(F.lit(D.EPOCH + 65 * D.HOUR)))
    return out.groupBy("code").agg(F.count(F.lit(1)).alias("violations"), F.count_distinct("case_id").alias("cases"))


@query("A38", D.with_ctes(D.CASES_SQL, body="SELECT truth, count(*) AS cases FROM cases GROUP BY truth"))
def label_census(t):
    """Cases per label."""
    return U.label_census(D.cases(t), "truth")


@query("J24", D.with_ctes(D.MATERIALS_SQL, body=f"""
, m AS (SELECT *, {D.ELIGIBILITY_SQL} AS reasons FROM (SELECT *, 1705500000 AS as_of FROM materials)),
r AS (SELECT doc_id, 'ineligible_material' AS code FROM m WHERE reasons <> '' UNION ALL SELECT doc_id, 'start_not_in_pool' FROM m WHERE doc_id % 9 = 0
  UNION ALL SELECT doc_id, 'text_differs_from_file' FROM m WHERE doc_id % 7 = 0 OR doc_id % 11 = 0
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 1 AND NOT (q <> '' AND instr(content, q) > 0 AND instr(substr(content, instr(content, q) + 1), q) = 0) THEN 'gold_quote_not_unique'
    WHEN doc_id % 2 = 0 AND contains(content, q) THEN 'withheld_quote_present' END
    FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'not in any text ~' ELSE substr(content, 4, 30) END AS q FROM m))
SELECT code, count(*) AS violations FROM r WHERE code IS NOT NULL GROUP BY code""".replace("\n, m AS", ", m AS", 1)))
def corpus_contract(t):
    """Corpus rules joined into one violation table, by code."""
    i = F.col("doc_id")
    m = A.with_eligibility(D.materials(t).withColumn("as_of", D.ts(F.lit(1705500000)))).withColumn("case_id", i)
    cases = m.select("case_id", F.when(i % 9 == 0, "gone").otherwise(F.col("version_id")).alias("source_version_id"))
    files = m.filter(i % 11 != 0).select("version_id", F.sha2(F.when(i % 7 == 0, F.lit("changed")).otherwise(F.col("content")), 256).alias("file_sha256"))
    quotes = m.select("case_id", "version_id", F.when(i % 3 == 0, "not in any text ~").otherwise(F.col("content").substr(4, 30)).alias("quote"), (i % 2 == 0).alias("withheld"))
    return U.corpus_contract(cases, m, files, quotes).groupBy("code").agg(F.count(F.lit(1)).alias("violations"))


@query("J27", """
SELECT event_id AS position, CASE WHEN event_id % 43 = 0 THEN 'missing' ELSE 'differs' END AS problem, event_id % 3 = 0 AS packet_ok
FROM events WHERE event_id % 43 = 0 OR event_id % 47 = 0""")
def registration_contract(t):
    """Run schedule against its registration by position; packets extend the base packet."""
    i = F.col("event_id")
    e = t("events")
    registered = e.select(i.alias("position"), F.col("user_id").alias("case_id"), F.col("event_type").alias("arm"))
    actual = e.filter(i % 43 != 0).select(i.alias("position"), F.col("user_id").alias("case_id"), F.when(i % 47 == 0, "other").otherwise(F.col("event_type")).alias("arm"))
    out = U.registration_contract(registered, actual, "position", ["case_id", "arm"])
    base, p = F.array(F.lit("p1"), F.lit("p2")), F.col("position")
    wider = F.when(p % 3 == 0, F.array(F.lit("p1"), F.lit("p2"), F.lit("p3"))).otherwise(F.array(F.lit("p2"), F.lit("p1"), F.lit("p3")))
    return out.withColumn("packet_ok", U.superset_packets(base, wider))


@query("A49", """
WITH h AS (SELECT user_id AS t, event_type || (k % 40) AS v, k % 9 = 0 AS revisit FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type IN ('view', 'click')),
a AS (SELECT t, count(*) AS accepted, count(*) FILTER (revisit) AS accepted_revisits FROM h GROUP BY t),
d AS (SELECT t, count(*) AS n FROM (SELECT t, v FROM h GROUP BY ALL HAVING count(*) > 1) GROUP BY t),
o AS (SELECT user_id AS t, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY ALL),
al AS (SELECT t, count(*) AS n FROM (SELECT DISTINCT t, v FROM h WHERE v LIKE 'view1%') GROUP BY t)
SELECT a.t AS trace_id, accepted, coalesce(d.n, 0) AS repeated_versions, accepted_revisits, coalesce(o.n, 0) AS revisit_operations, coalesce(al.n, 0) AS admitted_aliases,
  coalesce(d.n, 0) + accepted_revisits + coalesce(o.n, 0) + coalesce(al.n, 0) = 0 AS clean
FROM a LEFT JOIN d ON d.t = a.t LEFT JOIN o ON o.t = a.t LEFT JOIN al ON al.t = a.t""")
def trace_invariants(t):
    """Violations of incremental mode per trace."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = t("events").withColumn("version_id", F.concat("event_type", (k % 40).cast("string"))).withColumnRenamed("user_id", "trace_id")
    history = e.select("trace_id", "version_id", (k % 9 == 0).alias("revisit"), F.lit(False).alias("duplicate"), F.col("event_type").isin("view", "click").alias("accepted"))
    ops = e.select("trace_id", F.when(F.col("event_type") == "error", "revisit_requested").otherwise("other").alias("action"))
    aliases = e.filter("version_id LIKE 'view1%'").select("trace_id", "version_id")
    return U.trace_invariants(history, ops, aliases)


@query("A36", """
WITH RECURSIVE s AS (SELECT doc_id, text, st, st + 6 AS en, row_number() OVER (PARTITION BY doc_id ORDER BY st) AS n FROM
    (SELECT DISTINCT doc_id, text, CAST(j * 7 + (doc_id + j) % 3 AS BIGINT) AS st FROM documents, (VALUES (0), (1), (2), (3)) v(j)) WHERE st + 6 <= length(text)),
w AS (SELECT doc_id, n, st AS cs, en AS ce, 1 AS isl FROM s WHERE n = 1
  UNION ALL SELECT s.doc_id, s.n, CASE WHEN j THEN w.cs ELSE s.st END, CASE WHEN j THEN greatest(w.ce, s.en) ELSE s.en END, CASE WHEN j THEN isl ELSE isl + 1 END
  FROM w JOIN (SELECT * FROM s) s ON s.doc_id = w.doc_id AND s.n = w.n + 1,
  LATERAL (SELECT s.st <= w.ce OR (s.st - w.ce <= 2 AND NOT regexp_matches(substr(s.text, w.ce + 1, s.st - w.ce), '\\S')) AS j) q),
e AS (SELECT doc_id, isl, min(cs) AS st, max(ce) AS en FROM w GROUP BY ALL)
SELECT e.doc_id AS finding_id, st AS start, en AS "end", substr(d.text, st + 1, en - st) AS quote FROM e JOIN documents d ON d.doc_id = e.doc_id""")
def merged_spans(t):
    """Adjacent spans joined across short whitespace."""
    i = F.col("doc_id")
    d = t("documents").select("doc_id", "text").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    st = F.col("j") * 7 + (i + F.col("j")) % 3
    spans = d.select(i.alias("finding_id"), D.vid(i).alias("version_id"), st.alias("start"), (st + 6).alias("end"), F.length("text").alias("n")).filter("end <= n")
    return U.merged_spans(spans, D.materials(t), 2).select("finding_id", "start", "end", "quote")


_PROBES = """pr AS (SELECT event_id AS probe_id, user_id || '/' || CAST(ts AS DATE) AS target_id, d, CASE WHEN d = 0 AND event_type = 'error' THEN 'unresolved' WHEN d = 1 AND CAST(regexp_extract(props, '[0-9]+') AS INT) < 10 THEN 'unresolved'
    WHEN d = 2 AND value > 150 THEN 'contradicted' WHEN d = 2 AND value > 100 THEN 'conflicting' WHEN d = 3 AND hour(ts) >= 18 THEN 'contradicted' WHEN d = 3 AND hour(ts) < 6 THEN 'unresolved'
    ELSE 'supported' END AS v
  FROM events, (VALUES (0), (1), (2), (3)) x(d)),
pv AS (SELECT probe_id, any_value(target_id) AS target_id, CASE WHEN NOT (max(v) FILTER (d = 0) = 'supported' AND max(v) FILTER (d = 1) = 'supported' AND max(v) FILTER (d = 2) <> 'unresolved') THEN 'unresolved'
    WHEN max(v) FILTER (d = 2) <> 'supported' THEN max(v) FILTER (d = 2) WHEN bool_or(v = 'contradicted') THEN 'contradicted' WHEN bool_or(v = 'conflicting') THEN 'conflicting'
    WHEN bool_and(v = 'supported') THEN 'supported' ELSE 'unresolved' END AS verdict FROM pr GROUP BY probe_id)"""


def _probe_checks(t):
    """Every event as a probe: who from its type, where from its property, what from its value, when from its hour."""
    d, value, hour = F.col("d"), F.col("value"), F.hour("ts")
    rows = t("events").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(3))))
    v = (F.when((d == 0) & (F.col("event_type") == "error"), "unresolved")
         .when((d == 1) & (F.regexp_extract("props", "[0-9]+", 0).cast("int") < 10), "unresolved")
         .when((d == 2) & (value > 150), "contradicted").when((d == 2) & (value > 100), "conflicting")
         .when((d == 3) & (hour >= 18), "contradicted").when((d == 3) & (hour < 6), "unresolved").otherwise("supported"))
    return rows.select(F.col("event_id").alias("probe_id"), F.concat_ws("/", "user_id", F.to_date("ts").cast("string")).alias("target_id"), D.pick(d, "actor_subject", "scope_location", "predicate_object", "time").alias("dimension"), v.alias("verdict"))


@query("A46", f"WITH {_PROBES} SELECT probe_id, verdict FROM pv")
def probe_verdicts(t):
    """Dimension verdicts folded per probe, gated on actor and scope."""
    return U.probe_verdicts(_probe_checks(t))


@query("A35", f"""WITH {_PROBES} SELECT target_id, count(*) AS probes, CASE WHEN bool_or(verdict = 'contradicted') THEN 'contradicted' WHEN bool_or(verdict = 'conflicting') THEN 'conflicting'
  WHEN bool_and(verdict = 'supported') THEN 'supported' ELSE 'unresolved' END AS verdict FROM pv GROUP BY target_id""")
def target_verdicts(t):
    """Probe verdicts folded per target."""
    checks = _probe_checks(t)
    owner = checks.select("probe_id", "target_id").distinct()
    return U.target_verdicts(U.probe_verdicts(checks).join(owner, "probe_id"))


_POOL = """sp AS (SELECT doc_id AS p, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'https://s' || (doc_id // 5) || '.example.org/' END AS url, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS outlet,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS publish_time, CASE WHEN doc_id % 2 = 0 THEN 'wire' ELSE '' END AS source_type, doc_id % 6 = 0 AS orig,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE substr(text, 1, 5) END AS fact FROM documents),
pool AS (SELECT max(url) AS url, min(p) AS position, coalesce(arg_min(outlet, p) FILTER (outlet <> ''), '') AS outlet, coalesce(arg_min(publish_time, p) FILTER (publish_time <> ''), '') AS publish_time,
    coalesce(arg_min(source_type, p) FILTER (source_type <> ''), '') AS source_type, bool_or(orig) AS is_original, count(DISTINCT fact) FILTER (fact <> '') AS facts, count(*) AS rows,
    greatest(count(DISTINCT outlet) FILTER (outlet <> '') - 1, 0) + greatest(count(DISTINCT publish_time) FILTER (publish_time <> '') - 1, 0) AS conflicting_values
  FROM sp GROUP BY CASE WHEN url = '' THEN p::VARCHAR ELSE url END)"""


def _source_rows(t):
    i = F.col("doc_id")
    return t("documents").select(
        i.alias("position"), F.when(i % 10 == 0, "").otherwise(F.concat(F.lit("https://s"), F.floor(i / 5), F.lit(".example.org/"))).alias("url"),
        F.when(i % 3 == 0, "").otherwise(F.col("source")).alias("outlet"), F.when(i % 4 == 0, "").otherwise(F.col("lang")).alias("publish_time"),
        F.when(i % 2 == 0, "wire").otherwise("").alias("source_type"), (i % 6 == 0).alias("is_original"),
        F.when(i % 7 == 0, "").otherwise(F.substring("text", 1, 5)).alias("fact"))


@query("A30", f"WITH {_POOL} SELECT * FROM pool")
def source_pool_merge(t):
    """Sources merged by address, first filled field wins."""
    return U.source_pool(_source_rows(t))


@query("A30", f"""WITH {_POOL}, cell AS (
  SELECT url, p, 'outlet' AS field, outlet AS value FROM sp UNION ALL SELECT url, p, 'publish_time', publish_time FROM sp UNION ALL SELECT url, p, 'source_type', source_type FROM sp),
f AS (SELECT url, field, arg_min(value, p) AS first FROM cell WHERE url <> '' AND value <> '' GROUP BY ALL)
SELECT DISTINCT url, field, first, value AS additional FROM cell JOIN f USING (url, field) WHERE value <> '' AND value <> first""")
def source_conflicts(t):
    """Field values of merged sources that differ from the first one."""
    return U.source_conflicts(_source_rows(t))


@query("A31", f"""WITH {_POOL} SELECT (SELECT count(*) FROM pool) AS source_count, (SELECT count(DISTINCT source_type) FILTER (source_type <> '') FROM pool) AS source_types,
  (SELECT count(*) FROM labels WHERE quality = 1) AS consistent, (SELECT count(*) FROM labels WHERE quality <> 1) AS disputed,
  (SELECT count(*) FROM documents WHERE doc_id > 0) AS causal_nodes, (SELECT count(*) FROM documents WHERE doc_id > 0 AND n_chars % 3 = 0) AS grounded""")
def credibility_counts(t):
    """Sources, types, agreeing and disputed facts, grounded nodes."""
    facts = t("labels").select(F.when(F.col("quality") == 1, "consistent").otherwise("disputed").alias("agreement"))
    nodes = t("documents").select(F.when(F.col("doc_id") > 0, 1).otherwise(0).alias("depth"), (F.col("n_chars") % 3 == 0).alias("grounded"))
    return U.credibility(U.source_pool(_source_rows(t)), facts, nodes)


@query("A48 F38", """
SELECT page_id AS event_id, page_id % 9 AS proposed_count, CAST(page_id % 3 <> 0 AS BIGINT) AS unique_sources, CAST(1 AS BIGINT) AS rejected_refs FROM pages""")
def timeline_sources(t):
    """Timeline events with admitted distinct sources; proposed counts kept apart."""
    i = F.col("page_id")
    p = t("pages").select("page_id", "url")
    events = p.select(i.alias("event_id"), (i % 9).alias("proposed_count"))
    own = F.when(i % 3 == 0, F.lit("")).otherwise(F.col("url"))
    refs = p.select(i.alias("event_id"), F.explode(F.array(own, F.concat("url", F.lit("#zz")), own)).alias("url"))
    return U.timeline_rows(events, refs, p.select("url"))


@query("U6", D.with_ctes(D.GAP_EVENTS_SQL, body="""
SELECT target_id, gap_id, day::VARCHAR AS day FROM gap_events GROUP BY ALL HAVING bool_or(op = 'open') AND bool_or(op = 'close')"""))
def batch_conflicts(t):
    """Gaps one batch both reopens and resolves."""
    e = D.gap_events(t).withColumn("day", F.col("day").cast("string"))
    return U.batch_conflicts(e.filter("op = 'open'"), e.filter("op = 'close'"), ["target_id", "gap_id", "day"])


@query("J6 J7", D.with_ctes(D.MATERIALS_SQL, body="""
SELECT url, count(*) AS versions, arg_max(version_id, doc_id) AS last_version FROM materials GROUP BY url"""))
def versions_per_url(t):
    """All versions of an address and the last one by arrival."""
    return D.materials(t).groupBy("url").agg(F.count(F.lit(1)).alias("versions"), F.max_by("version_id", "doc_id").alias("last_version"))


@query("J6", D.with_ctes(D.MATERIALS_SQL, body="""
SELECT url, version_id, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS number FROM materials"""))
def url_versions(t):
    """Every version of an address in order of arrival."""
    from pyspark.sql import Window as W
    return D.materials(t).select("url", "version_id", F.row_number().over(W.partitionBy("url").orderBy("doc_id")).cast("long").alias("number"))


@query("J8 G8", """
WITH a AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), r AS (SELECT u, min(page_id) AS page_id FROM a GROUP BY u)
SELECT q.n AS request, r.page_id FROM (SELECT page_id AS n, CASE WHEN page_id % 2 = 0 THEN u ELSE (SELECT any_value(b.u) FROM a b WHERE b.page_id = a.page_id - 1) END AS u FROM a) q JOIN r ON r.u = q.u""")
def redirect_lookup(t):
    """First document per requested address, redirects resolved through the alias table."""
    i = F.col("page_id")
    pages = t("pages").select(i, F.regexp_replace("url", "#.*$", "").alias("u"))
    first = pages.groupBy("u").agg(F.min("page_id").alias("doc"))
    aliases = pages.filter(i % 2 == 0).select(F.concat(F.lit("https://short.example.org/"), i + 1).alias("u"), F.col("u").alias("final_url"))
    requests = pages.select(i.alias("request"), F.when(i % 2 == 0, F.col("u")).otherwise(F.concat(F.lit("https://short.example.org/"), i)).alias("u"))
    target = requests.join(aliases, "u", "left").select("request", F.coalesce("final_url", "u").alias("u"))
    return target.join(first, "u").select("request", F.col("doc").alias("page_id"))
