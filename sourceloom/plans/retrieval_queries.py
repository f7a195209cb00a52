"""Task retrieval over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import evidence_terms, norm_ws, search_terms
from ..functions.claims import content_tokens, ordered_match, word_forms
from ..operators import retrieval as R
from . import derive as D
from .registry import query

_STOP = "('the','and','for','that','with','find','provide','source','record','target','evidence')"
_TERMS = f"""tt AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS term FROM benchmark) WHERE term NOT IN {_STOP}),
dt AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS term FROM documents) WHERE term NOT IN {_STOP})"""


def _tasks(t):
    return t("benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("query"))


def _docs(t):
    return t("documents").select("doc_id", "text").select(F.col("doc_id").alias("version_id"), "text")


@query("T1 T2 T8", D.with_ctes(_TERMS, body="""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, version_id) AS rank FROM
  (SELECT item_id AS task_id, doc_id AS version_id, count(*) AS score FROM tt JOIN dt USING (term) GROUP BY ALL)) WHERE rank <= 5"""))
def lexical_topk(t):
    """Five best documents per task by distinct shared terms."""
    out = R.lexical_topk(_tasks(t), _docs(t), 5)
    return out.select("task_id", "version_id", "score", F.col("rank").cast("long").alias("rank"))


@query("T1 X14", f"""
WITH a AS (SELECT doc_id, count(DISTINCT term) FILTER (term NOT IN {_STOP}) AS search_terms FROM
    (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS term FROM documents) GROUP BY doc_id),
b AS (SELECT doc_id, count(DISTINCT term) FILTER (term NOT IN ('the','and','that','this','with','from','before','after','until','has','have','had','was','were','will')) AS evidence_terms FROM
    (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9%]{{3,}}')) AS term FROM documents) GROUP BY doc_id)
SELECT d.doc_id, coalesce(search_terms, 0) AS search_terms, coalesce(evidence_terms, 0) AS evidence_terms
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id""")
def term_counts(t):
    """Distinct routing terms and grounding terms per document."""
    x = F.col("text")
    return t("documents").select("doc_id", "text").select("doc_id", F.size(search_terms(x)).cast("long").alias("search_terms"),
                                 F.size(evidence_terms(x)).cast("long").alias("evidence_terms"))


@query("J14 T8", D.with_ctes(D.MATERIALS_SQL, body="""
SELECT version_id, url, issuer, substr(content, 1, 800) AS preview FROM materials m JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)
WHERE available_at <= 1705000000 AND lang <> 'en'"""))
def catalog_preview(t):
    """Preview of versions that were not returned yet and were available at the cutoff."""
    m = D.materials(t)
    returned = t("documents").filter("lang = 'en'").select(F.floor(F.col("doc_id") / 21).alias("pool_id"), D.vid(F.col("doc_id")).alias("version_id"))
    return R.catalog(m, returned, D.ts(F.lit(1705000000))).select("version_id", "url", "issuer", "preview")


_POOL_TASKS = D.MATERIALS_SQL + """, alltasks AS (
  SELECT pool_id, 't' || doc_id AS task_id, ['fetch','reanalyse','search'][(doc_id % 3) + 1] AS action,
    CASE WHEN doc_id % 3 < 2 THEN 'q' ELSE content END AS question,
    CASE WHEN doc_id % 3 = 2 THEN NULL WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN url ELSE version_id END AS locator FROM materials),
tasks AS (SELECT * FROM alltasks WHERE action <> 'search'),
ret AS (SELECT pool_id, version_id FROM materials WHERE issuer IN ('src1', 'src4', 'src9', 'src12', 'src16')),
opt AS (SELECT DISTINCT t.pool_id, t.task_id, m.version_id FROM tasks t JOIN materials m ON m.pool_id = t.pool_id AND (m.url = t.locator OR m.version_id = t.locator)
    WHERE action = 'fetch' AND m.version_id NOT IN (SELECT version_id FROM ret)
  UNION SELECT t.pool_id, t.task_id, t.locator FROM tasks t WHERE action = 'reanalyse' AND t.locator IN (SELECT version_id FROM ret))"""


def _pool_tasks(t):
    """Every document states one task of its pool; versions of five issuers were returned before."""
    m, i = D.materials(t), F.col("doc_id")
    tasks = m.select(
        "pool_id", F.concat(F.lit("t"), i).alias("task_id"), D.pick(i % 3, "fetch", "reanalyse", "search").alias("action"),
        F.when(i % 3 < 2, "q").otherwise(F.col("content")).alias("question"),
        F.when(i % 3 == 2, F.lit(None)).when((i % 2 == 0) & (i % 3 == 0), F.col("url")).otherwise(F.col("version_id")).alias("locator"))
    returned = m.filter(F.col("issuer").isin("src1", "src4", "src9", "src12", "src16")).select("pool_id", "version_id")
    return m, tasks, returned


def _exact(tasks):
    return tasks.filter("action <> 'search'")


@query("J12 T3 T5", D.with_ctes(_POOL_TASKS, body="SELECT pool_id, task_id, version_id FROM opt"))
def locator_candidates(t):
    """Candidate versions of exact tasks, by address or version id."""
    m, tasks, returned = _pool_tasks(t)
    return R.candidates(_exact(tasks), m, returned).distinct()


@query("T3", D.with_ctes(_POOL_TASKS, body="""
SELECT pool_id, task_id, row_number() OVER (PARTITION BY pool_id ORDER BY CASE action WHEN 'fetch' THEN 0 WHEN 'reanalyse' THEN 1 ELSE 2 END, action, coalesce(locator, ''), question, task_id) AS position FROM alltasks"""))
def task_priority(t):
    """Order of tasks inside a pool: fetch, reanalyse, search, then locator, question and id."""
    from pyspark.sql import Window as W
    _, tasks, _ = _pool_tasks(t)
    return tasks.select("pool_id", "task_id", F.row_number().over(W.partitionBy("pool_id").orderBy(*R.task_order())).cast("long").alias("position"))


@query("T4 T5")
def greedy_cover(t):
    """At most three versions per pool chosen so that constrained tasks are covered first."""
    m, tasks, returned = _pool_tasks(t)
    options = R.candidates(tasks, m, returned)
    return R.greedy_cover(tasks, options, 3)


@query("T5 T10", D.with_ctes(_POOL_TASKS, body="""
, ch AS (SELECT pool_id, min(version_id) AS version_id FROM opt GROUP BY pool_id)
SELECT o.pool_id, o.version_id, o.task_id FROM opt o JOIN ch ON ch.pool_id = o.pool_id AND ch.version_id = o.version_id
""".replace("\n, ch AS", ", ch AS", 1)))
def version_answers(t):
    """Which tasks each returned version answers, one version per pool returned."""
    m, tasks, returned = _pool_tasks(t)
    options = R.candidates(_exact(tasks), m, returned)
    return R.attribution(options.groupBy("pool_id").agg(F.min("version_id").alias("version_id")), options)


@query("T6 T5", D.with_ctes(_POOL_TASKS, body="""
, ch AS (SELECT pool_id, min(version_id) AS version_id FROM opt GROUP BY pool_id),
f AS (SELECT t.pool_id, t.task_id, count(ch.version_id) AS returned, count(o.version_id) AS n FROM tasks t LEFT JOIN opt o ON o.task_id = t.task_id
  LEFT JOIN ch ON ch.pool_id = o.pool_id AND ch.version_id = o.version_id GROUP BY ALL)
SELECT pool_id, task_id, returned, CASE WHEN returned > 0 THEN 'returned' WHEN n > 0 THEN 'budget_exhausted' ELSE 'unavailable' END AS status FROM f
""".replace("\n, ch AS", ", ch AS", 1)))
def task_feedback(t):
    """Status per task when one version per pool was returned."""
    m, tasks, returned = _pool_tasks(t)
    tasks = _exact(tasks)
    options = R.candidates(tasks, m, returned)
    chosen = options.groupBy("pool_id").agg(F.min("version_id").alias("version_id"))
    return R.task_feedback(tasks, options, chosen)


@query("T7 J19", """
WITH i AS (SELECT CAST(ts AS DATE)::VARCHAR AS round, event_id AS task_id, event_type AS action FROM events WHERE event_type <> 'error'),
r AS (SELECT CAST(ts AS DATE)::VARCHAR AS round, event_id AS task_id, CASE WHEN event_id % 3 = 0 THEN 'v' || user_id END AS got FROM events),
f AS (SELECT CAST(ts AS DATE)::VARCHAR AS round, event_id AS task_id, CASE WHEN event_id % 17 = 0 THEN 'view!' ELSE event_type END AS action,
  CASE event_id % 4 WHEN 0 THEN 'returned' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'budget_exhausted' ELSE 'lost' END AS status,
  CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 1 ELSE 0 END AS named FROM events)
SELECT f.round, f.task_id, concat_ws(',', CASE WHEN i.task_id IS NULL THEN 'unissued_task' END, CASE WHEN f.action <> i.action THEN 'changed_task' END,
  CASE WHEN status = 'lost' THEN 'invalid_status' END, CASE WHEN status = 'returned' AND (got IS NULL OR named = 0) THEN 'returned_mismatch' END,
  CASE WHEN status <> 'returned' AND (got IS NOT NULL OR named > 0) THEN 'non_returned_conflict' END) AS reasons
FROM f LEFT JOIN i ON i.task_id = f.task_id LEFT JOIN r ON r.task_id = f.task_id""")
def feedback_contract(t):
    """Provider feedback against issued tasks and attributed returns."""
    e, i = t("events"), F.col("event_id")
    base = e.select(F.to_date("ts").cast("string").alias("round"), i.alias("task_id"), "event_type", "user_id")
    task = F.col("task_id")
    issued = base.filter("event_type <> 'error'").select("round", "task_id", F.col("event_type").alias("action"), F.lit(None).cast("string").alias("locator"))
    version = F.concat(F.lit("v"), "user_id")
    returns = base.filter(task % 3 == 0).select("round", "task_id", version.alias("version_id"))
    feedback = base.select(
        "round", "task_id", F.when(task % 17 == 0, "view!").otherwise(F.col("event_type")).alias("action"), F.lit(None).cast("string").alias("locator"),
        D.pick(task % 4, "returned", "unavailable", "budget_exhausted", "lost").alias("status"),
        F.when((task % 2 == 0) & (task % 3 == 0), F.array(version)).otherwise(F.array().cast("array<string>")).alias("version_ids"))
    return R.feedback_codes(feedback, issued, returns).withColumn("reasons", F.array_join("reasons", ","))


@query("T9 J6", """
WITH f AS (SELECT source, regexp_extract(text, '^\\s*(\\S+)', 1) AS w, min(doc_id) AS doc_id FROM documents GROUP BY ALL)
SELECT source, w AS word, rank, n > 6 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM f) WHERE rank <= 6""")
def bounded_lists(t):
    """First six distinct values per source by first appearance, with a truncation flag."""
    rows = t("documents").select("source", F.regexp_extract("text", r"^\s*(\S+)", 1).alias("word"), "doc_id")
    kept, flags = R.bounded_distinct(rows, "source", "word", "doc_id", 6)
    return kept.join(flags, "source").select("source", "word", F.col("rank").cast("long").alias("rank"), "truncated")


@query("T10", """
SELECT conv_id, least(count(*), 3) AS kept, greatest(count(*) - 3, 0) AS omitted FROM conversations GROUP BY conv_id""")
def capped_claims(t):
    """Claims kept and omitted per item under the cap."""
    return R.kept_and_omitted(t("conversations"), "conv_id", 3)


@query("T10", """
WITH c AS (SELECT conv_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS claim, min(turn) AS turn FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY ALL)
SELECT conv_id, claim, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, claim) <= 3 AS kept FROM c""")
def omitted_claims(t):
    """Distinct claims of an item in order of appearance: the three kept and the list of those left out."""
    rows = t("conversations").select("conv_id", "turn", norm_ws(F.col("text")).alias("claim"))
    return R.split_capped(rows, "conv_id", "claim", "turn", 3).select("conv_id", "claim", "turn", "kept")


@query("X13", """
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS t FROM documents),
f AS (SELECT t, unnest(list_distinct([t] ||
  CASE WHEN t LIKE '%ing' AND length(t) > 5 THEN [t[:-4], t[:-4] || 'e'] ELSE [] END ||
  CASE WHEN t LIKE '%ed' AND length(t) > 4 THEN [t[:-3], t[:-3] || 'e'] ELSE [] END ||
  CASE WHEN t LIKE '%es' AND length(t) > 4 THEN [t[:-3], t[:-3] || 'e', t[:-2]] WHEN t LIKE '%s' AND length(t) > 3 THEN [t[:-2]] ELSE [] END)) AS form FROM w)
SELECT t AS token, count(*) AS forms, array_to_string(list_sort(list(form)), ',') AS joined FROM f GROUP BY t""")
def word_form_table(t):
    """Every distinct word with its stems."""
    tokens = t("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("token")).distinct()
    forms = word_forms(F.col("token"))
    return tokens.select("token", F.size(forms).cast("long").alias("forms"), F.array_join(F.array_sort(forms), ",").alias("joined"))


@query("X13 X15", """
WITH p AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM p),
f AS (SELECT *, list_concat([t],
    CASE WHEN t LIKE '%ing' AND length(t) > 5 THEN [t[:-4], t[:-4] || 'e'] ELSE [] END,
    CASE WHEN t LIKE '%ed' AND length(t) > 4 THEN [t[:-3], t[:-3] || 'e'] ELSE [] END,
    CASE WHEN t LIKE '%es' AND length(t) > 4 THEN [t[:-3], t[:-3] || 'e', t[:-2]] WHEN t LIKE '%es' AND length(t) = 4 THEN [t[:-2]]
      WHEN t LIKE '%s' AND t NOT LIKE '%es' AND length(t) > 3 THEN [t[:-2]] ELSE [] END) AS forms FROM x),
probe AS (SELECT doc_id, max(CASE WHEN i = 1 + CASE WHEN n % 3 = 0 THEN 2 * n // 3 ELSE n // 3 END THEN forms END) AS a,
    max(CASE WHEN i = 1 + CASE WHEN n % 3 = 0 THEN n // 3 ELSE 2 * n // 3 END THEN forms END) AS b FROM f GROUP BY doc_id),
one AS (SELECT f.doc_id, min(i) AS i FROM f JOIN probe USING (doc_id) WHERE list_has_any(forms, a) GROUP BY f.doc_id),
two AS (SELECT DISTINCT f.doc_id FROM f JOIN probe USING (doc_id) JOIN one ON one.doc_id = f.doc_id WHERE f.i > one.i AND list_has_any(forms, b))
SELECT doc_id, doc_id IN (SELECT doc_id FROM two) AS in_order FROM documents""")
def ordered_tokens(t):
    """Whether the words at one and two thirds of a text occur, in some form, in the probed order."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)
    rows = t("documents").select("doc_id", w.alias("w"), F.size(w).alias("n"))
    early, late = (F.get("w", (F.col("n") * k / 3).cast("int")) for k in (1, 2))
    probe = F.when(F.col("n") % 3 == 0, F.array(late, early)).otherwise(F.array(early, late))
    found = F.when(F.col("n") > 0, ordered_match(probe, F.col("w"))).otherwise(F.lit(False))
    return rows.select("doc_id", found.alias("in_order"))


@query("X13", """
SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: x NOT IN ('the','and','that','this','with','from','before','after','until','since','today',
 'tomorrow','yesterday','well','also','for','into','onto','over','under','between','during','about','will','would','can','could','may','might','must','should','has','have','had','was','were',
 'are','does','did','not'))) AS tokens FROM documents""")
def content_token_counts(t):
    """Content tokens per document."""
    return t("documents").select("doc_id", F.size(content_tokens(F.col("text"))).cast("long").alias("tokens"))
