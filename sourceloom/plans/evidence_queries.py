"""Evidence policy, independent sources and version admission over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_hash, fold, norm_ws
from ..functions.urls import canonical_url, public_url, url_key
from ..operators import admission as A
from ..operators import grouping as G
from . import derive as D
from .registry import query

def admitted(t):
    """Evidence rows that no policy check rejects."""
    return A.validate_evidence(D.evidence(t), D.claims(t)).filter(F.size("reasons") == 0)


# Components by the smallest reachable row: rows meet at the keys they share.
_WALK = """keyed AS (SELECT {scope} AS claim, doc_id, unnest(['p' || publisher, 'o' || origin, 'h' || hash, 'u' || url]) AS k FROM {rows}),
edge AS (SELECT DISTINCT a.claim, a.doc_id AS u, b.doc_id AS v FROM keyed a JOIN keyed b ON a.claim = b.claim AND a.k = b.k),
walk AS (SELECT DISTINCT claim, doc_id AS root, doc_id AS node FROM keyed
  UNION SELECT w.claim, w.root, e.v FROM walk w JOIN edge e ON e.claim = w.claim AND e.u = w.node),
comp AS (SELECT claim, node AS doc_id, min(root) AS component FROM walk GROUP BY ALL)"""

_COMPONENTS = D.EVIDENCE_SQL + ", " + _WALK.format(scope="claim", rows="ev") + """,
grp AS (SELECT c.claim, component, bool_or(stance = 'supports') AS s, bool_or(stance = 'contradicts') AS x,
    bool_or(stance = 'neutral') AS n, count(*) AS rows
  FROM comp c JOIN ev e ON e.claim = c.claim AND e.doc_id = c.doc_id GROUP BY ALL)"""


@query("F1 F2 F3 G1 G2 A1", D.with_ctes(_COMPONENTS, body="""
SELECT claim, count(*) FILTER (s) AS supports, count(*) FILTER (x) AS contradicts, count(*) FILTER (n) AS neutral,
  count(*) AS total, count(*) FILTER (s AND x) AS conflicting,
  CASE WHEN bool_or(s) AND bool_or(x) THEN 'conflicting' WHEN count(*) FILTER (s) >= 2 THEN 'supported'
    WHEN count(*) FILTER (x) >= 2 THEN 'contradicted' ELSE 'unresolved' END AS decision
FROM grp GROUP BY claim"""))
def decision_by_independent_sources(t):
    """Claim decision from independent sources, transitive copies collapsed."""
    return G.independent_decision(admitted(t), ["searched_claim"]).withColumnRenamed("searched_claim", "claim")


@query("G1 G2", D.with_ctes(_COMPONENTS, body="""
SELECT claim, rows, s AS has_supports, x AS has_contradicts, n AS has_neutral, s AND x AS conflicting,
  count(*) AS groups FROM grp GROUP BY ALL"""))
def source_group_sizes(t):
    """Census of source groups per claim by size and stance mix."""
    signatures, _ = G.source_groups(admitted(t), ["searched_claim"], G.evidence_keys(), id_col="doc_id",
                                    carry=G.stance_flags())
    groups = G.group_summary(signatures, ["searched_claim"])
    return groups.groupBy(F.col("searched_claim").alias("claim"), "rows", "has_supports", "has_contradicts",
                          "has_neutral", "conflicting").agg(F.count(F.lit(1)).alias("groups"))


@query("G1", D.with_ctes(D.EVIDENCE_SQL.replace("WHERE reasons = ''", ""), _WALK.format(scope="split_part(claim, '/', 1)", rows="ev"), body="""
SELECT claim AS lang, count(*) AS groups, max(n) AS largest, sum(n)::BIGINT AS rows
FROM (SELECT claim, component, count(*) AS n FROM comp GROUP BY ALL) GROUP BY ALL"""))
def language_source_groups(t):
    """Stress case: one scope per language, so large components and long chains occur."""
    ev = D.evidence(t).withColumn("lang", F.split("searched_claim", "/")[0])
    signatures, _ = G.source_groups(ev, ["lang"], G.evidence_keys(), id_col="doc_id", carry=G.stance_flags())
    return G.group_summary(signatures, ["lang"]).groupBy("lang").agg(
        F.count(F.lit(1)).alias("groups"), F.max("rows").alias("largest"), F.sum("rows").alias("rows"))


_ROUND_COMPONENTS = D.EVIDENCE_SQL + """,
vis AS (SELECT claim || '#' || r AS claim, doc_id, publisher, origin, hash, url, stance FROM ev, (VALUES (1), (2), (3)) v(r) WHERE doc_id % 3 + 1 <= r), """ \
    + _WALK.format(scope="claim", rows="vis") + """,
grp AS (SELECT c.claim, component, bool_or(stance = 'supports') AS s, bool_or(stance = 'contradicts') AS x
  FROM comp c JOIN vis e ON e.claim = c.claim AND e.doc_id = c.doc_id GROUP BY ALL),
dec AS (SELECT split_part(claim, '#', 1) AS claim, CAST(split_part(claim, '#', 2) AS BIGINT) AS upto_round,
    count(*) FILTER (s) AS supports, count(*) FILTER (x) AS contradicts,
    CASE WHEN bool_or(s) AND bool_or(x) THEN 'conflicting' WHEN count(*) FILTER (s) >= 2 THEN 'supported'
      WHEN count(*) FILTER (x) >= 2 THEN 'contradicted' ELSE 'unresolved' END AS decision
  FROM grp GROUP BY ALL)"""


def _rounds(t):
    ev = admitted(t).withColumn("round", (F.col("doc_id") % 3 + 1).cast("int"))
    return G.decision_per_round(ev, "searched_claim", "round", 3)


@query("W2", D.with_ctes(_ROUND_COMPONENTS, body="SELECT claim, upto_round, supports, contradicts, decision FROM dec"))
def cumulative_decision(t):
    """Decision over the evidence so far, per claim and round."""
    return _rounds(t).select(F.col("searched_claim").alias("claim"), F.col("upto_round").cast("long").alias("upto_round"),
                             "supports", "contradicts", "decision")


@query("A27 W12", D.with_ctes(_ROUND_COMPONENTS, body="""
SELECT coalesce(a.decision, 'unresolved') AS single_pass, b.decision AS loop, count(*) AS claims,
  count(*) FILTER (coalesce(a.decision, 'unresolved') = b.decision) AS same
FROM (SELECT * FROM dec WHERE upto_round = 3) b LEFT JOIN (SELECT * FROM dec WHERE upto_round = 1) a ON a.claim = b.claim
GROUP BY ALL"""))
def policy_single_pass_vs_loop(t):
    """First-round decision against the decision after all rounds."""
    per = _rounds(t).groupBy("searched_claim").agg(
        F.coalesce(F.max(F.when(F.col("upto_round") == 1, F.col("decision"))), F.lit("unresolved")).alias("single_pass"),
        F.max_by("decision", "upto_round").alias("loop"))
    return per.groupBy("single_pass", "loop").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(F.col("single_pass") == F.col("loop")).alias("same"))


@query("F1 F2 F3 X1 X16 X20 X22", D.with_ctes(D.EVIDENCE_SQL, body="SELECT doc_id, reasons FROM judged"))
def evidence_reject_reasons(t):
    """Reason codes of every evidence row under the admission policy."""
    out = A.validate_evidence(D.evidence(t), D.claims(t))
    return out.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("F4 J3", D.with_ctes(D.MATERIALS_SQL, D.TARGETS_SQL, body=f"""
SELECT target_id, version_id, {D.ELIGIBILITY_SQL} AS reasons FROM targets JOIN materials USING (pool_id)"""))
def eligible_at_cutoff(t):
    """Every version of a target's pool with its reason codes at the target's cutoff."""
    rows = A.with_eligibility(D.targets(t).join(D.materials(t).drop("content"), "pool_id"))
    return rows.select("target_id", "version_id", F.array_join("reasons", ",").alias("reasons"))


@query("J3 F6", D.with_ctes(D.MATERIALS_SQL, D.TARGETS_SQL, body="""
SELECT target_id, count(*) AS visible, min(available_at) AS first_available
FROM targets JOIN materials USING (pool_id) WHERE available_at <= as_of GROUP BY target_id"""))
def visible_versions(t):
    """Time-bounded join: versions available at or before each target's cutoff."""
    rows = D.targets(t).join(D.materials(t), "pool_id").filter(A.available_by(F.col("as_of")))
    return rows.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("visible"), F.unix_seconds(F.min("available_at")).alias("first_available"))


@query("F5 F6", D.with_ctes(D.MATERIALS_SQL, D.TARGETS_SQL, body=f"""
SELECT target_id, count(*) AS versions, count(*) FILTER (reasons = '') AS by_codes,
  count(*) FILTER (coalesce(availability_basis IS NOT NULL AND available_at <= as_of AND available_at <= retrieved_at
    AND (published_at IS NULL OR (published_at <= as_of AND published_at <= retrieved_at)), false)) AS strict,
  count(*) FILTER (available_at <= as_of) AS available
FROM (SELECT *, {D.ELIGIBILITY_SQL} AS reasons FROM targets JOIN materials USING (pool_id)) GROUP BY target_id"""))
def eligibility_agreement(t):
    """The coded rule, the strict boolean and the availability-only rule side by side."""
    rows = A.with_eligibility(D.targets(t).join(A.version_facts(D.materials(t)), "pool_id"))
    return rows.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("versions"), F.count_if(F.size("reasons") == 0).alias("by_codes"),
        F.count_if(A.strictly_eligible(F.col("as_of"))).alias("strict"),
        F.count_if(A.available_by(F.col("as_of"))).alias("available"))


@query("F32", D.with_ctes(D.MATERIALS_SQL, D.TARGETS_SQL, body="""
SELECT t.target_id, count(version_id) AS inventory, count(*) FILTER (version_id = source_version_id) AS origin_versions,
  count(*) FILTER (version_id = source_version_id) = 1 AS packet_ok
FROM targets t LEFT JOIN materials m ON m.pool_id = t.pool_id AND available_at <= as_of GROUP BY t.target_id"""))
def claim_packets(t):
    """Inventory and the exactly-one-origin guard per target."""
    return A.claim_packets(D.targets(t), D.materials(t)).select("target_id", "inventory", "origin_versions", "packet_ok")


@query("F33", D.with_ctes(D.MATERIALS_SQL, D.TARGETS_SQL, body=f"""
SELECT target_id AS case_id, count(*) FILTER (reasons = '') AS pool_eligible, count(*) FILTER (reasons <> '') AS pool_excluded,
  count(*) FILTER (reasons = '' AND doc_id % 3 = 0) AS initial_eligible,
  count(*) FILTER (reasons <> '' AND doc_id % 3 = 0) AS initial_excluded
FROM (SELECT *, {D.ELIGIBILITY_SQL} AS reasons FROM targets JOIN materials USING (pool_id)) GROUP BY target_id"""))
def scope_packets(t):
    """Packet sizes per case for the whole pool and for its initial versions."""
    m = D.materials(t)
    initial = m.filter("doc_id % 3 = 0").select("pool_id", "version_id")
    return A.scope_packets(D.targets(t).withColumnRenamed("target_id", "case_id"), m.drop("content"), initial)


@query("F32", D.with_ctes(D.MATERIALS_SQL, D.TARGETS_SQL, body="""
SELECT target_id, version_id, version_id = source_version_id AS is_source FROM targets JOIN materials USING (pool_id) WHERE available_at <= as_of"""))
def packet_inventory(t):
    """Versions each target may see."""
    return A.packet_inventory(D.targets(t), D.materials(t).select("pool_id", "version_id", "available_at"))


@query("F32 X9", D.with_ctes(D.MATERIALS_SQL, D.TARGETS_SQL, D.PASSAGES_SQL, body="""
SELECT target_id, version_id, passage_id, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS text FROM targets JOIN materials m USING (pool_id) JOIN passages p ON p.doc_id = m.doc_id
WHERE version_id = source_version_id AND available_at <= as_of"""))
def packet_passages(t):
    """Passages that a complete packet shows: those of its one source version."""
    return A.packet_passages(D.targets(t), D.materials(t))


@query("F33", D.with_ctes(D.MATERIALS_SQL, D.TARGETS_SQL, body=f"""
SELECT target_id AS case_id, version_id, doc_id % 3 = 0 AS initial, {D.ELIGIBILITY_SQL} AS reasons FROM targets JOIN materials USING (pool_id)"""))
def case_materials(t):
    """Materials of each case with the reasons why some are excluded."""
    m = D.materials(t)
    out = A.scope_rows(D.targets(t).withColumnRenamed("target_id", "case_id"), m.drop("content"), m.filter("doc_id % 3 = 0").select("pool_id", "version_id"))
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("F34", D.with_ctes(D.MATERIALS_SQL, body=f"""
, r AS (SELECT *, {D.ELIGIBILITY_SQL} AS reasons FROM (SELECT *, 1705500000 AS as_of FROM materials))
SELECT url, arg_min(reasons, doc_id) AS reasons, count(*) AS rejected_rows FROM r WHERE reasons <> '' GROUP BY url
""".replace("\n, r AS", "SELECT * FROM (WITH r AS") + ")"))
def document_admission(t):
    """One reject row per address for documents outside the cutoff."""
    rows = A.with_eligibility(D.materials(t).withColumn("as_of", D.ts(F.lit(1705500000))))
    return A.first_rejects(rows, "url", "doc_id").select("url", F.array_join("reasons", ",").alias("reasons"), "rejected_rows")


@query("F18", """
WITH a AS (SELECT doc_id, 'k' || (doc_id // 3) AS key, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS fp FROM documents),
f AS (SELECT key, min(doc_id) AS first_at, arg_min(fp, doc_id) AS fp FROM a GROUP BY key)
SELECT doc_id, CASE WHEN doc_id = first_at THEN 'first' WHEN a.fp = f.fp THEN 'duplicate' ELSE 'collision' END AS arrival
FROM a JOIN f USING (key)""")
def version_collisions(t):
    """Arrivals under one id: first, benign duplicate or collision."""
    rows = t("documents").select("doc_id", F.concat(F.lit("k"), F.floor(F.col("doc_id") / 3)).alias("key"),
                                 F.md5(norm_ws(F.col("text"))).alias("fp"))
    return A.classify_arrivals(rows, "key", "fp", "doc_id").select("doc_id", "arrival")


@query("F17", """
SELECT lang AS batch, md5(text) AS key, count(*) AS uses FROM documents GROUP BY ALL HAVING count(*) > 1""")
def duplicate_batch_keys(t):
    """Keys used more than once inside one batch."""
    rows = t("documents").select(F.col("lang").alias("batch"), F.md5("text").alias("key"))
    return A.duplicate_keys(rows, ["batch"], "key")


@query("F19", """
SELECT regexp_extract(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^[^ ]+ [^ ]+', 0) AS finding, count(DISTINCT source) AS owners,
  count(DISTINCT md5(text)) AS definitions FROM documents GROUP BY finding
HAVING count(DISTINCT source) > 1 AND count(DISTINCT md5(text)) > 1""")
def owner_redefinitions(t):
    """Finding ids that several owners define differently."""
    rows = t("documents").select(F.regexp_extract(norm_ws(F.col("text")), "^[^ ]+ [^ ]+", 0).alias("finding"),
                                 F.col("source").alias("owner"), F.md5("text").alias("fp"))
    return A.owner_conflicts(rows, "finding", "owner", "fp")


@query("F29 X6", """
SELECT count(*) AS versions, count(DISTINCT doc_id) AS ids, count(DISTINCT text || '|' || (doc_id % 7) || '|' || (doc_id // 21)
  || '|' || source || '|' || CASE WHEN doc_id % 11 = 0 THEN 'n' ELSE (doc_id % 700 + (doc_id % 3) * 48)::VARCHAR END
  || '|' || CASE WHEN doc_id % 5 = 0 THEN 'n' ELSE (doc_id % 700 - doc_id % 90 + CASE WHEN doc_id % 97 = 0 THEN 400 ELSE 0 END)::VARCHAR END
  || '|' || (doc_id % 13 <> 0)) AS distinct_records FROM documents""")
def canonical_records(t):
    """Publisher-version projection and the number of distinct record fingerprints."""
    m = A.publisher_fields(D.materials(t))
    return m.agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("version_id").alias("ids"),
                 F.count_distinct(A.material_fingerprint(with_id=False)).alias("distinct_records"))


@query("F30", D.with_ctes(D.MATERIALS_SQL, D.TARGETS_SQL, body="""
SELECT target_id, version_id, doc_id % 2 = 0 AS seen, CASE WHEN doc_id % 2 <> 0 THEN length(content) END AS full_chars,
  CASE WHEN doc_id % 2 = 0 THEN sha256(content) END AS content_sha256, CASE WHEN doc_id % 2 = 0 THEN length(content) END AS content_chars
FROM targets JOIN materials USING (pool_id)"""))
def incremental_projection(t):
    """Full text for unseen versions of a target, hash and length for seen ones."""
    m = D.materials(t)
    pool = D.targets(t).join(m.select("pool_id", "doc_id", "version_id"), "pool_id")
    out = A.delta_projection(pool, m, pool.filter("doc_id % 2 = 0"))
    return out.select("target_id", "version_id", "seen", F.length("content").cast("long").alias("full_chars"), "content_sha256", "content_chars")


@query("F31 F38 U2", """
WITH known AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?#]+)$', '\\1/') AS k FROM pages),
p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '#frag' WHEN 1 THEN regexp_replace(url, '#.*$', '') || 'zz' ELSE 'mailto:x' END AS u FROM pages)
SELECT page_id, regexp_replace(regexp_replace(u, '#.*$', ''), '^(https?://[^/?#]+)$', '\\1/') IN (SELECT k FROM known) AS known FROM p""")
def known_source_proposals(t):
    """Proposed sources kept only when their address was fetched."""
    pages = t("pages")
    i = F.col("page_id")
    url = F.when(i % 3 == 0, F.concat("url", F.lit("#frag"))).when(
        i % 3 == 1, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("zz"))).otherwise("mailto:x")
    return A.known_proposals(pages.select("page_id", url.alias("url")), pages).select("page_id", "known")


@query("X16 X17 X18", """
SELECT page_id, lower(regexp_extract(u, '^(https?://[^/?#]*)', 1)) || CASE WHEN regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/'
    ELSE regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) END || CASE WHEN contains(u, '?') THEN '?' || regexp_extract(u, '\\?(.*)$', 1) ELSE '' END AS url_key,
  sha256(url) AS raw_hash FROM (SELECT *, regexp_replace(url, '#.*$', '') AS u FROM pages)""")
def url_keys(t):
    """Comparison keys of page addresses."""
    return t("pages").select("page_id", url_key(F.col("url")).alias("url_key"), F.sha2("url", 256).alias("raw_hash"))


_URL_PARTS = """u AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS head, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
  regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)"""


@query("X16", f"""
WITH {_URL_PARTS}
SELECT page_id, head || CASE path WHEN '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS canonical
FROM (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND x NOT LIKE 'utm_%'
  AND split_part(x, '=', 1) NOT IN ('fbclid', 'gclid', 'msclkid'))) AS kept FROM u)""")
def canonical_urls(t):
    """Canonical form of page addresses written otherwise: host folded, default port, tracking keys and fragment dropped, query sorted."""
    u = F.col("url")
    head, rest = F.regexp_extract(u, "^(https?://[^/?#]+)", 1), F.regexp_extract(u, "^https?://[^/?#]+([^#]*)", 1)
    raw = F.concat(F.upper(head), F.when(u.startswith("https"), ":443").otherwise(":80"), rest,
                   F.when(rest.contains("?"), "&").otherwise("?"), F.lit("utm_medium=z&fbclid=1"), F.lit("#s"))
    return t("pages").select("page_id", canonical_url(raw).alias("canonical"))


@query("X17", f"""
WITH {_URL_PARTS}
SELECT page_id, CASE WHEN contains(url, '#') OR url LIKE '%.html' THEN NULL ELSE head || CASE path WHEN '' THEN '/' ELSE path END
  || CASE q WHEN '' THEN '' ELSE '?' || q END END AS public FROM u""")
def public_urls(t):
    """Public form: private hosts rejected, query order kept; some pages stand at private addresses."""
    u = F.col("url")
    head, rest = F.regexp_extract(u, "^(https?://[^/?#]+)", 1), F.regexp_extract(u, "^https?://[^/?#]+([^#]*)", 1)
    raw = F.when(u.contains("#"), F.concat(F.lit("http://10.0.0."), F.length(u) % 250, rest)).when(
        u.endswith(".html"), F.concat(F.lit("http://printer.local"), rest)).otherwise(
        F.concat(F.upper(head), F.when(u.startswith("https"), ":443").otherwise(":80"), rest, F.lit("#q")))
    return t("pages").select("page_id", public_url(raw).alias("public"))
