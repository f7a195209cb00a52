"""Role tables that Spark derives from the given tables, with the same roles in SQL.

Each function returns a DataFrame; the matching ``*_SQL`` text is a CTE body for
the comparison queries.  Times are UTC timestamps here and epoch seconds there.
Every query reads whole tables.  Conditions on a number only decide which part a
row plays, or plant the defects that an audit has to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import LINEAGE_KINDS as LINEAGE
from .registry import Tables

EPOCH = 1704067200  # 2024-01-01T00:00:00Z
HOUR = 3600


def ts(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def pick(c: Column, *values) -> Column:
    """Nth of the listed values by position."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c + 1).cast("int"))


def vid(c: Column) -> Column:
    return F.concat(F.lit("v"), c.cast("string"))


# -- evidence rows and claims ------------------------------------------------

def claim_of() -> Column:
    return F.concat_ws("/", "lang", (F.col("n_chars") % 5).cast("string"))


def evidence(t: Tables) -> DataFrame:
    """Documents as evidence; a claim groups documents of one language and length class.

    Exact copies in one source have the same claim, publisher, origin, address and content, so they fold; documents of
    one source and length share an address.  The quote starts at a third of the text, the origin is told by five words in its middle.
    """
    d = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    i, n = F.col("doc_id"), F.col("n_chars")
    pub = F.lit(EPOCH) + (n % 200) * HOUR
    even = F.trim(F.regexp_replace("text", r"\s+", " "))
    iso = lambda s: F.date_format(ts(s), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return d.select(
        "doc_id", claim_of().alias("searched_claim"),
        F.when(i % 101 == 0, F.lit("other")).otherwise(claim_of()).alias("claim_id"),
        F.when(i % 103 == 0, F.lit(" ")).otherwise(F.concat(F.lit("e"), i)).alias("id"),
        F.when(i % 19 == 0, F.concat(F.lit("ftp://"), "source", F.lit("/x"))).otherwise(
            F.concat(F.lit("https://"), F.upper("source"), F.lit(".example.org:443/"), n,
                     F.lit("?utm_source=a&b=2&a=1#top"))).alias("url"),
        F.concat_ws("/", "source", F.floor(n / 40).cast("string")).alias("publisher_group"),
        F.regexp_extract(F.trim(even.substr(F.floor(F.length(even) / 2).cast("int") + 1, F.length(even))), r"^((?:[^ ]+ ){0,4}[^ ]+)", 1).alias("origin_id"),
        F.when(i % 17 == 0, F.substring(iso(pub), 1, 19)).otherwise(iso(pub)).alias("published_at"),
        iso(pub + ((i % 5) - 1) * HOUR).alias("retrieved_at"),
        F.col("text").alias("content"),
        F.when(i % 13 == 0, F.lit("no such words ~")).otherwise(F.col("text").substr(F.floor(F.length("text") / 3).cast("int") + 1, F.lit(40))).alias("quote"),
        F.when(i % 107 == 0, F.lit("maybe")).when(F.col("quality") == 1, "supports").when(
            F.col("quality") == 0, "contradicts").otherwise("neutral").alias("stance"))


def claims(t: Tables) -> DataFrame:
    return t("documents").select(claim_of().alias("id")).distinct().withColumn("as_of", ts(F.lit(EPOCH + 150 * HOUR)))


EVIDENCE_SQL = """ev0 AS (
  SELECT d.doc_id, d.lang || '/' || (n_chars % 5) AS claim, text, source, n_chars, l.quality,
    trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n,
    1704067200 + (n_chars % 200) * 3600 AS p, 1704067200 + (n_chars % 200 + d.doc_id % 5 - 1) * 3600 AS r, 1704607200 AS cut,
    trim(regexp_replace(CASE WHEN d.doc_id % 13 = 0 THEN 'no such words ~' ELSE substr(text, length(text) // 3 + 1, 40) END, '\\s+', ' ', 'g')) AS q
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
judged AS (
  SELECT *, CASE WHEN doc_id % 103 = 0 OR q = '' THEN concat_ws(',', CASE WHEN doc_id % 103 = 0 THEN 'missing_or_empty_id' END,
    CASE WHEN q = '' THEN 'missing_or_empty_quote' END) ELSE concat_ws(',',
  CASE WHEN doc_id % 101 = 0 THEN 'claim_id_mismatch' END, CASE WHEN doc_id % 107 = 0 THEN 'invalid_stance' END,
  CASE WHEN doc_id % 19 = 0 THEN 'invalid_url' END, CASE WHEN doc_id % 17 = 0 THEN 'invalid_published_at' END,
  CASE WHEN doc_id % 17 <> 0 AND p > cut THEN 'future_published_at' END, CASE WHEN r > cut THEN 'future_retrieved_at' END,
  CASE WHEN doc_id % 17 <> 0 AND cut - p > 72 * 3600 THEN 'stale_published_at' END,
  CASE WHEN doc_id % 17 <> 0 AND r < p THEN 'retrieved_before_published' END,
  CASE WHEN NOT contains(n, q) THEN 'quote_not_in_content' END) END AS reasons
  FROM ev0),
ev AS (
  SELECT claim, doc_id, source || '/' || (n_chars // 40) AS publisher, lower(regexp_extract(trim(substr(n, length(n) // 2 + 1)), '^((?:[^ ]+ ){0,4}[^ ]+)', 1)) AS origin,
    CASE WHEN doc_id % 19 <> 0 THEN source || '/' || n_chars END AS url, sha256(lower(n)) AS hash,
    CASE WHEN quality = 1 THEN 'supports' WHEN quality = 0 THEN 'contradicts' ELSE 'neutral' END AS stance
  FROM judged WHERE reasons = '')"""


# -- versioned materials and targets ------------------------------------------

def materials(t: Tables) -> DataFrame:
    """Documents as versions; three neighbours of a block share one address."""
    i = F.col("doc_id")
    base = F.lit(EPOCH) + (i % 700) * HOUR
    return t("documents").select(
        "doc_id", F.floor(i / 21).alias("pool_id"), vid(i).alias("version_id"),
        F.concat(F.lit("https://pub"), (i % 7).cast("string"), F.lit(".example.org/a/"), F.floor(i / 21)).alias("url"),
        F.col("text").alias("content"), F.col("source").alias("issuer"),
        ts(base + 72 * HOUR).alias("retrieved_at"),
        F.when(i % 5 != 0, ts(base - (i % 90) * HOUR + F.when(i % 97 == 0, 400 * HOUR).otherwise(0))).alias("published_at"),
        F.when(i % 11 != 0, ts(base + (i % 3) * 48 * HOUR)).alias("available_at"),
        F.when(i % 13 != 0, F.lit("capture")).alias("availability_basis"))


MATERIALS_SQL = """materials AS (
  SELECT doc_id, doc_id // 21 AS pool_id, 'v' || doc_id AS version_id,
    'https://pub' || (doc_id % 7) || '.example.org/a/' || (doc_id // 21) AS url,
    text AS content, source AS issuer,
    1704067200 + (doc_id % 700) * 3600 + 259200 AS retrieved_at,
    CASE WHEN doc_id % 5 <> 0 THEN 1704067200 + (doc_id % 700) * 3600 - (doc_id % 90) * 3600
      + CASE WHEN doc_id % 97 = 0 THEN 1440000 ELSE 0 END END AS published_at,
    CASE WHEN doc_id % 11 <> 0 THEN 1704067200 + (doc_id % 700) * 3600 + (doc_id % 3) * 172800 END AS available_at,
    CASE WHEN doc_id % 13 <> 0 THEN 'capture' END AS availability_basis
  FROM documents)"""


def targets(t: Tables) -> DataFrame:
    """One target per document; its pool is the document's block."""
    i = F.col("doc_id")
    return t("documents").select(
        F.concat(F.lit("t"), i).alias("target_id"), F.floor(i / 21).alias("pool_id"), vid(i).alias("source_version_id"),
        ts(F.lit(EPOCH) + (i % 700) * HOUR + (i % 4) * 30 * HOUR).alias("as_of"))


TARGETS_SQL = """targets AS (
  SELECT 't' || doc_id AS target_id, doc_id // 21 AS pool_id, 'v' || doc_id AS source_version_id,
    1704067200 + (doc_id % 700) * 3600 + (doc_id % 4) * 108000 AS as_of FROM documents)"""

ELIGIBILITY_SQL = """concat_ws(',',
    CASE WHEN published_at > retrieved_at THEN 'published_after_retrieval' END,
    CASE WHEN published_at > as_of THEN 'published_after_as_of' END,
    CASE WHEN available_at IS NULL THEN 'version_availability_unknown' END,
    CASE WHEN available_at IS NOT NULL AND availability_basis IS NULL THEN 'version_availability_unsubstantiated' END,
    CASE WHEN availability_basis IS NOT NULL AND available_at > as_of THEN 'version_available_after_as_of' END,
    CASE WHEN available_at > retrieved_at THEN 'available_after_retrieval' END)"""


# -- sentence passages (SQL only) ----------------------------------------------

PASSAGES_SQL = """b AS (SELECT doc_id, text, regexp_replace(text, '([.!?])(\\s+)([A-Z0-9\\[(])', '\\1' || chr(1) || '\\2\\3', 'g') AS m FROM documents),
p AS (SELECT doc_id, text, string_split(m, chr(1)) AS ps FROM b),
r AS (SELECT doc_id, text, unnest(ps) AS piece, generate_subscripts(ps, 1) AS n FROM p),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0 FROM r),
k AS (SELECT doc_id, n, at0 + length(piece) - length(regexp_replace(piece, '^\\s+', '')) AS st, regexp_replace(regexp_replace(piece, '^\\s+', ''), '\\s+$', '') AS body FROM o),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS num FROM k WHERE length(regexp_replace(body, '\\s+', ' ', 'g')) >= 24),
passages AS (
SELECT doc_id, CASE WHEN num < 1000 THEN 'p' || lpad(num::VARCHAR, 3, '0') ELSE 'p' || num END AS passage_id, st::BIGINT AS start, (st + length(body))::BIGINT AS "end", body FROM g
UNION ALL SELECT doc_id, 'p001', 0, length(text), text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g) AND trim(text) <> '')"""


# -- lineage graph -------------------------------------------------------------

MORE = 10_000_000  # number of a document's second edge


def relations(t: Tables) -> DataFrame:
    """Typed edges between documents: chains towards document 0, with shortcuts and cycles where the length decides.

    Every document points at the one of half its number; some also at the one of a third (two ways up), and some at one of
    those that point at them (a cycle).
    """
    d, i, n = t("documents").filter("doc_id > 0"), F.col("doc_id"), F.col("n_chars")
    edge = lambda rows, number, to, kind, status: rows.select(
        F.concat(F.lit("r"), number).alias("relation_id"), vid(i).alias("from_version"), vid(to).alias("to_version"), kind.alias("kind"), status.alias("status"))
    first = edge(d, i, F.floor(i / 2), F.when(i % 7 == 0, "supports").otherwise(pick(i % 5, *LINEAGE)), F.when(i % 11 == 0, "declared").otherwise("direct"))
    extra = d.filter((i > 3) & ((n % 29 == 0) | (n % 37 == 0)))
    return first.unionByName(edge(extra, i + MORE, F.when(n % 29 == 0, F.floor(i / 3)).otherwise(2 * i + 1), F.lit("cites"), F.lit("direct")))


RELATIONS_SQL = f"""relations AS (
  SELECT 'r' || doc_id AS relation_id, 'v' || doc_id AS from_version, 'v' || (doc_id // 2) AS to_version,
    CASE WHEN doc_id % 7 = 0 THEN 'supports'
      ELSE ['quotes','cites','reprints','translates','derives'][(doc_id % 5) + 1] END AS kind,
    CASE WHEN doc_id % 11 = 0 THEN 'declared' ELSE 'direct' END AS status
  FROM documents WHERE doc_id > 0
  UNION ALL SELECT 'r' || (doc_id + {MORE}), 'v' || doc_id, 'v' || CASE WHEN n_chars % 29 = 0 THEN doc_id // 3 ELSE 2 * doc_id + 1 END, 'cites', 'direct'
  FROM documents WHERE doc_id > 3 AND (n_chars % 29 = 0 OR n_chars % 37 = 0))"""


def origins(t: Tables) -> DataFrame:
    """Originals are the documents whose length ends in 0."""
    i = F.col("doc_id")
    return t("documents").filter(F.col("n_chars") % 10 == 0).select(
        vid(i).alias("version_id"), pick(i % 4, "original_record", "original_interview", "original_dataset",
                                         "original_observation").alias("material_kind"))


ORIGINS_SQL = """origins AS (
  SELECT 'v' || doc_id AS version_id,
    ['original_record','original_interview','original_dataset','original_observation'][(doc_id % 4) + 1] AS material_kind
  FROM documents WHERE n_chars % 10 = 0)"""


# -- call log ------------------------------------------------------------------

def calls(t: Tables) -> DataFrame:
    """Events as model calls: arm by user parity, stage by type, tokens from the value."""
    i, u = F.col("event_id"), F.col("user_id")
    tokens = F.when(i % 19 != 0, F.floor(F.col("value") * 10).cast("long"))
    return t("events").select(
        i.alias("sequence"), F.when(u % 2 == 0, "direct").otherwise("harness").alias("arm"),
        F.floor(u / 2).alias("case_id"), F.col("event_type").alias("stage"),
        (F.col("event_type") != "error").alias("success"), tokens.alias("input_tokens"),
        F.when(i % 23 != 0, i % 50).alias("output_tokens"),
        F.when(i % 3 == 0, F.floor(tokens / 2)).alias("cached_input_tokens"),
        (F.col("value") / 10).alias("wall_seconds"), F.when(i % 4 == 0, "loop").otherwise("full").alias("variant"))


CALLS_SQL = """calls AS (
  SELECT event_id AS sequence, CASE WHEN user_id % 2 = 0 THEN 'direct' ELSE 'harness' END AS arm,
    user_id // 2 AS case_id, event_type AS stage, event_type <> 'error' AS success,
    CASE WHEN event_id % 19 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS input_tokens,
    CASE WHEN event_id % 23 <> 0 THEN event_id % 50 END AS output_tokens,
    CASE WHEN event_id % 3 = 0 AND event_id % 19 <> 0 THEN CAST(floor(value * 10) AS BIGINT) // 2 END AS cached_input_tokens,
    value / 10 AS wall_seconds, CASE WHEN event_id % 4 = 0 THEN 'loop' ELSE 'full' END AS variant
  FROM events)"""


# -- gold and predictions --------------------------------------------------------

LABELS = ["true", "false", "disputed", "unverifiable"]


def cases(t: Tables) -> DataFrame:
    """Labelled documents as gold cases next to a rule-made prediction."""
    i, n = F.col("doc_id"), F.col("n_chars")
    truth = F.when((F.col("toxic") == 0) & (F.col("quality") == 1), "true").when(
        F.col("toxic") == 0, "false").when(F.col("quality") == 1, "disputed").otherwise("unverifiable")
    guess = pick(n % 7, "true", "true", "true", "false", "false", "disputed", "unverifiable")
    weights = [1 + n % 5, 1 + n % 3, 1 + n % 2, F.lit(1)]
    total = weights[0] + weights[1] + weights[2] + 1
    rows = t("labels").join(t("documents").select("doc_id", "source", "n_chars"), "doc_id")
    root = F.concat(F.lit("root"), (i % 50).cast("string"))
    return rows.select(
        i.alias("id"), F.col("source").alias("event_id"), truth.alias("truth"),
        ((F.col("toxic") == 1) | (i % 4 == 0)).alias("high_risk"),
        F.when(i % 3 != 0, truth).otherwise(guess).alias("decision"),
        *[(w / total).alias(f"p_{l}") for w, l in zip(weights, LABELS)],
        (i % 6 != 0).alias("traceable"),
        F.when(i % 6 != 0, F.array(F.array(root), F.array(root, F.lit("root_shared")))).otherwise(
            F.array().cast("array<array<string>>")).alias("acceptable_roots"),
        F.when(i % 4 == 3, "unresolved").otherwise("resolved").alias("source_status"),
        F.when(i % 4 == 3, F.array().cast("array<string>")).when(i % 8 == 1, F.array(F.lit("root_shared"), root)).when(
            i % 8 == 2, F.array(F.lit("elsewhere"))).otherwise(F.array(root)).alias("roots"))


CASES_SQL = """cases AS (
  SELECT l.doc_id AS id, d.source AS event_id, truth, (toxic = 1 OR l.doc_id % 4 = 0) AS high_risk,
    CASE WHEN l.doc_id % 3 <> 0 THEN truth ELSE
      ['true','true','true','false','false','disputed','unverifiable'][(n_chars % 7) + 1] END AS decision,
    (1 + n_chars % 5) / w AS p_true, (1 + n_chars % 3) / w AS p_false, (1 + n_chars % 2) / w AS p_disputed,
    1 / w AS p_unverifiable, l.doc_id % 6 <> 0 AS traceable,
    CASE WHEN l.doc_id % 4 = 3 THEN 'unresolved' ELSE 'resolved' END AS source_status,
    'root' || (l.doc_id % 50) AS root,
    CASE WHEN l.doc_id % 4 = 3 THEN [] WHEN l.doc_id % 8 = 1 THEN ['root_shared', 'root' || (l.doc_id % 50)]
      WHEN l.doc_id % 8 = 2 THEN ['elsewhere'] ELSE ['root' || (l.doc_id % 50)] END AS roots
  FROM (SELECT *, CASE WHEN toxic = 0 AND quality = 1 THEN 'true' WHEN toxic = 0 THEN 'false'
      WHEN quality = 1 THEN 'disputed' ELSE 'unverifiable' END AS truth FROM labels) l
  JOIN (SELECT doc_id, source, n_chars, CAST(4 + n_chars % 5 + n_chars % 3 + n_chars % 2 AS DOUBLE) AS w
      FROM documents) d ON d.doc_id = l.doc_id)"""


def case_edges(t: Tables, predicted: bool) -> DataFrame:
    """Annotated (or predicted) lineage edges: case to its report to its root."""
    i = F.col("doc_id")
    name, mid = F.concat(F.lit("case"), i), F.concat(F.lit("mid"), i)
    root = F.concat(F.lit("root"), (i % 50).cast("string"))
    edge = lambda a, b, r: F.struct(a.alias("from"), b.alias("to"), F.lit(r).alias("relation"))
    gold = F.array(edge(name, mid, "cites"), edge(mid, root, "derived_from"), edge(mid, F.lit("root_shared"), "quotes"))
    ours = F.array(edge(name, mid, "cites"), F.when(i % 5 != 0, edge(mid, root, "derived_from")),
                   F.when(i % 8 == 1, edge(mid, F.lit("root_shared"), "quotes")),
                   F.when(i % 9 == 0, edge(mid, F.lit("noise"), "cites")))
    return t("labels").select(i.alias("id"), F.explode(F.array_compact(ours) if predicted else gold).alias("e")).select(
        "id", "e.from", "e.to", "e.relation")


GOLD_EDGES_SQL = """gold_edges AS (
  SELECT doc_id AS id, 'case' || doc_id AS "from", 'mid' || doc_id AS "to", 'cites' AS relation FROM labels
  UNION ALL SELECT doc_id, 'mid' || doc_id, 'root' || (doc_id % 50), 'derived_from' FROM labels
  UNION ALL SELECT doc_id, 'mid' || doc_id, 'root_shared', 'quotes' FROM labels)"""
PRED_EDGES_SQL = """pred_edges AS (
  SELECT doc_id AS id, 'case' || doc_id AS "from", 'mid' || doc_id AS "to", 'cites' AS relation FROM labels
  UNION ALL SELECT doc_id, 'mid' || doc_id, 'root' || (doc_id % 50), 'derived_from' FROM labels WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, 'mid' || doc_id, 'root_shared', 'quotes' FROM labels WHERE doc_id % 8 = 1
  UNION ALL SELECT doc_id, 'mid' || doc_id, 'noise', 'cites' FROM labels WHERE doc_id % 9 = 0)"""


def case_evidence(t: Tables) -> DataFrame:
    """Three judged evidence rows per case; some are not reported by the prediction."""
    rows = t("labels").select(F.col("doc_id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    i, j = F.col("i"), F.col("j")
    stance = pick((i + j) % 3, "supports", "contradicts", "neutral")
    reported = (i + j) % 4 != 0
    return rows.select(
        i.alias("id"), j.alias("evidence"), stance.alias("gold_stance"),
        F.concat(F.lit("o"), ((i + j) % 2).cast("string")).alias("gold_origin"), reported.alias("reported"),
        F.when(reported, F.when((i + j) % 5 != 0, stance).otherwise("neutral")).alias("stance"),
        F.when(reported, F.concat(F.lit("p"), ((i * 3 + j) % 2).cast("string"))).alias("origin"))


CASE_EVIDENCE_SQL = """case_evidence AS (
  SELECT doc_id AS id, j AS evidence, ['supports','contradicts','neutral'][((doc_id + j) % 3) + 1] AS gold_stance,
    'o' || ((doc_id + j) % 2) AS gold_origin, (doc_id + j) % 4 <> 0 AS reported,
    CASE WHEN (doc_id + j) % 4 <> 0 THEN CASE WHEN (doc_id + j) % 5 <> 0
      THEN ['supports','contradicts','neutral'][((doc_id + j) % 3) + 1] ELSE 'neutral' END END AS stance,
    CASE WHEN (doc_id + j) % 4 <> 0 THEN 'p' || ((doc_id * 3 + j) % 2) END AS origin
  FROM labels, (VALUES (0), (1), (2)) v(j))"""


# -- gaps --------------------------------------------------------------------------

def gap_events(t: Tables) -> DataFrame:
    """Events as open and close steps of evidence gaps; the event number is the epoch."""
    i, u = F.col("event_id"), F.col("user_id")
    op = F.when(F.col("event_type").isin("purchase", "error"), "close").otherwise("open")
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").select(
        F.concat(F.lit("u"), u).alias("target_id"), F.concat(F.lit("g"), (k % 4).cast("string")).alias("gap_id"),
        op.alias("op"), i.alias("epoch"), F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").alias("slot"),
        (k % 3 == 0).alias("blocking"),
        F.concat(F.lit("basis"), (k % 5).cast("string")).alias("basis"),
        F.when(k % 4 < 2, "provenance").otherwise("verification").alias("stage"),
        F.concat(F.lit("owner"), (i % 3).cast("string")).alias("owner"))


GAP_EVENTS_SQL = """gap_events AS (
  SELECT 'u' || user_id AS target_id, 'g' || (k % 4) AS gap_id,
    CASE WHEN event_type IN ('purchase', 'error') THEN 'close' ELSE 'open' END AS op, event_id AS epoch, CAST(ts AS DATE) AS day,
    k % 3 = 0 AS blocking, 'basis' || (k % 5) AS basis,
    CASE WHEN k % 4 < 2 THEN 'provenance' ELSE 'verification' END AS stage, 'owner' || (event_id % 3) AS owner
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""


def with_ctes(*parts: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
