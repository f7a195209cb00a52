"""Streaming twins, gates and extension points over the given tables.

Streams replay a table by file batches; the sink is a parquet folder under the
checkpoint folder, read back as the result.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..operators import state as S
from ..session import cut, ensure_checkpoint_dir
from ..streaming import arrivals as A
from ..streaming import plugins as P
from . import derive as D
from .registry import query


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _replay(df, part, parts: int, start) -> None:
    """Let a table arrive in ``parts`` steps: append the rows of one step, then run the stream over what is new.

    ``start`` gets the streaming DataFrame and returns a started query; the
    query resumes from its own checkpoint in every step.
    """
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    staged = cut(df.withColumn("_part", part))
    for n in range(parts):
        staged.filter(F.col("_part") == n).drop("_part").write.mode("append").parquet(folder)
        start(spark.readStream.schema(df.schema).parquet(folder)).awaitTermination()


def _run(df, part, parts: int, job, mode: str):
    """Run ``job`` as a stream over the replayed table; returns its rows with the batch number."""
    spark, out = df.sparkSession, _folder(df.sparkSession)

    def sink(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/n={batch_id}")

    _replay(df, part, parts, lambda stream: job(stream).writeStream.outputMode(mode).foreachBatch(sink).option(
        "checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    return spark.read.parquet(f"{out}/data").drop("n")


def _thirds(df, column: str):
    """Arrival step 0, 1 or 2 by position in the column's range."""
    top = df.agg(F.max(column).alias("_max"))
    return df.join(F.broadcast(top)).withColumn("step", F.least(F.floor(F.col(column) * 3 / (F.col("_max") + 1)), F.lit(2))).drop("_max")


@query("R1 S2", """
WITH a AS (SELECT doc_id, 'k' || (doc_id // 3) AS version_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS fp FROM documents),
f AS (SELECT version_id, min(doc_id) AS p, arg_min(fp, doc_id) AS fp FROM a GROUP BY version_id)
SELECT a.doc_id, CASE WHEN a.doc_id = p THEN 'first' WHEN a.fp = f.fp THEN 'duplicate' ELSE 'collision' END AS arrival FROM a JOIN f USING (version_id)""")
def stream_dedup(t):
    """Arrivals classified across micro-batches against a growing table of first fingerprints."""
    d = t("documents").select(F.col("doc_id").alias("position"), F.concat(F.lit("k"), F.floor(F.col("doc_id") / 3)).alias("version_id"),
                              F.md5(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("fingerprint"))
    out = _folder(t.spark)
    _replay(_thirds(d, "position"), F.col("step"), 3, lambda stream: stream.writeStream.foreachBatch(A.classified_batches(out)).option(
        "checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    return t.spark.read.parquet(f"{out}/arrivals").select(F.col("position").alias("doc_id"), "arrival")


@query("R3", D.with_ctes(D.GAP_EVENTS_SQL, body="""
SELECT target_id, gap_id, coalesce(max(epoch) FILTER (op = 'open'), -1) AS last_open, coalesce(max(epoch) FILTER (op = 'close'), -1) AS last_close,
  CASE WHEN coalesce(max(epoch) FILTER (op = 'open'), -1) > coalesce(max(epoch) FILTER (op = 'close'), -1) THEN 'open' ELSE 'closed' END AS state FROM gap_events GROUP BY target_id, gap_id"""))
def stream_gap_ledger(t):
    """Gap ledger in streaming state; events arrive out of order and the epochs decide."""
    e = D.gap_events(t).select("target_id", "gap_id", "op", "epoch")
    out = _run(e, F.pmod("epoch", F.lit(3)), 3, A.gap_ledger_stream, "update")
    last = out.groupBy("target_id", "gap_id").agg(F.max_by(F.struct("last_open", "last_close", "state"), "batch").alias("s"))
    return last.select("target_id", "gap_id", "s.*")


@query("R2", D.with_ctes(D.MATERIALS_SQL, body=f"""
SELECT version_id, CASE WHEN {D.ELIGIBILITY_SQL} = '' THEN 'graph' ELSE 'archive' END AS sink FROM (SELECT *, 1705500000 AS as_of FROM materials)"""))
def stream_late_routing(t):
    """Versions available after the cutoff are archived, not dropped."""
    m = D.materials(t).withColumn("as_of", D.ts(F.lit(1705500000))).drop("content")
    out = _run(_thirds(m, "doc_id"), F.col("step"), 3, lambda stream: A.route_late(stream).select("version_id", "sink"), "append")
    return out.select("version_id", "sink")


@query("R5", """
SELECT event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true) AS verified FROM events""")
def input_gate(t):
    """Rounds that need a new verification because their input changed."""
    r = t("events").select(F.col("user_id").cast("string").alias("target_id"), F.col("event_id").alias("round"), F.col("event_type").alias("fingerprint"), F.date_trunc("hour", "ts").alias("slot"))
    return A.input_gate(r, "slot").select(F.col("round").alias("event_id"), "verified")


@query("R5", """
SELECT event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true) AS verified FROM events""")
def stream_input_gate(t):
    """The same gate over micro-batches in round order, with the last fingerprints as state."""
    r = t("events").select(F.col("user_id").cast("string").alias("target_id"), F.col("event_id").alias("round"), F.col("event_type").alias("fingerprint"))
    out = _folder(t.spark)
    _replay(_thirds(r, "round"), F.col("step"), 3, lambda stream: stream.writeStream.foreachBatch(A.gated_batches(out)).option(
        "checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    return t.spark.read.parquet(f"{out}/rounds").select(F.col("round").alias("event_id"), "verified")


@query("R6 R7", """
WITH r AS (SELECT user_id AS target_id, CAST(ts AS DATE) AS day, count(*) AS documents, count(*) FILTER (event_type = 'click') AS calls, count(*) FILTER (event_type = 'error') AS gaps FROM events GROUP BY ALL),
s AS (SELECT *, row_number() OVER w AS rounds_used, sum(documents) OVER w AS documents_used, sum(calls) OVER w AS calls_used FROM r WINDOW w AS (PARTITION BY target_id ORDER BY day))
SELECT target_id, rounds_used, CAST(documents_used AS BIGINT) AS documents_used, CAST(calls_used AS BIGINT) AS calls_used, documents_used > 60 OR calls_used > 20 AS over_budget,
  gaps > 0 AND rounds_used < 12 AND documents_used < 60 AND calls_used < 20 AS deferred FROM s""")
def budget_counters(t):
    """Rounds, documents and calls used per target, overflow, and deferral behind a blocking gap."""
    e = t("events").groupBy(F.col("user_id").alias("target_id"), F.to_date("ts").alias("round")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("event_type") == "click").alias("calls"), F.count_if(F.col("event_type") == "error").alias("gaps"))
    out = A.budget_counters(e.withColumn("month", F.trunc("round", "month")), "month", 60, 20)
    c = F.col
    return out.select("target_id", "rounds_used", "documents_used", "calls_used", "over_budget",
                      A.deferred(c("documents"), c("rounds_used") < 12, 60 - c("documents_used"), 20 - c("calls_used"), c("gaps")).alias("deferred"))


@query("R8", """
SELECT md5(text) AS version_id, min(doc_id) AS position FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'de') GROUP BY ALL""")
def unprocessed_versions(t):
    """Versions still to decompose: first arrivals the processed ledger does not hold."""
    d = t("documents").select(F.md5("text").alias("version_id"), F.col("doc_id").alias("position"), "lang")
    return A.unprocessed(d, d.filter("lang = 'de'"))


@query("P1 R7", """
WITH k AS (SELECT doc_id // 21 AS pool_id, 'v' || doc_id AS version_id, row_number() OVER (PARTITION BY doc_id // 21 ORDER BY n_chars DESC, doc_id) AS rn, doc_id FROM documents)
SELECT pool_id, version_id, 'task' || pool_id AS task_id FROM k WHERE rn <= 2""")
def provider_returns(t):
    """A retrieval provider plugged in as a DataFrame function: two longest versions per pool."""
    from ..operators.skew import top_k

    def longest(tasks, pool):
        best = top_k(pool, ["pool_id"], [F.col("n").desc(), F.col("doc_id")], 2)
        return best.join(tasks, "pool_id").select("pool_id", "version_id", "task_id")

    provider: P.Provider = longest
    pool = D.materials(t).select("pool_id", "version_id", "doc_id", F.length("content").alias("n"))
    tasks = pool.select("pool_id").distinct().withColumn("task_id", F.concat(F.lit("task"), "pool_id"))
    return provider(tasks, pool)


@query("P3 P5", """
SELECT doc_id, 't' || doc_id AS target_id, length(text) AS chars, '' AS reasons FROM documents""")
def whole_text_fragments(t):
    """Conservative decomposition of each target's own source, checked before it joins the graph."""
    m = D.materials(t).filter(F.length("content") > 0)
    own = m.withColumn("pool_id", F.col("doc_id"))
    targets = m.select(F.concat(F.lit("t"), "doc_id").alias("target_id"), F.col("doc_id").alias("pool_id"))
    frags = P.whole_text_fragments(targets, own)
    codes = P.fragment_codes(frags, m)
    n = frags.select("target_id", F.col("end").cast("long").alias("chars"))
    return codes.join(n, "target_id").select(F.substring("target_id", 2, 20).cast("long").alias("doc_id"), "target_id", "chars", F.array_join("reasons", ",").alias("reasons"))


def _first_line(frame: pd.DataFrame) -> pd.DataFrame:
    """A decomposer: the first line of the text as one fragment, and one with a wrong offset on odd ids."""
    line = frame["content"].str.split("\n", n=1).str[0]
    odd = frame["doc_id"] % 2 == 1
    return pd.DataFrame({
        "target_id": frame["target_id"], "version_id": frame["version_id"], "fragment_id": frame["version_id"] + ":line",
        "parent_id": frame["target_id"].where(frame["doc_id"] % 3 != 0, "nowhere"), "text": line,
        "start": odd.astype("int32"), "end": line.str.len().astype("int32") + odd.astype("int32"), "quote": line})


@query("P2 P5", """
WITH f AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS line FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN NOT (line <> '' AND (doc_id % 2 = 0 OR (length(line) + 1 <= length(text) AND substr(text, 2, length(line)) = line))) THEN 'invalid_span' END,
  CASE WHEN doc_id % 3 = 0 THEN 'no_path_to_target' END) AS reasons FROM f""")
def decomposer_output(t):
    """A Python decomposer in Arrow batches, its output checked as DataFrame steps."""
    m = D.materials(t)
    rows = m.select("doc_id", F.concat(F.lit("t"), "doc_id").alias("target_id"), "version_id", "content")
    codes = P.fragment_codes(P.decompose(rows, _first_line), m)
    return codes.select(F.substring("target_id", 2, 20).cast("long").alias("doc_id"), F.array_join("reasons", ",").alias("reasons"))


@query("P5 F8", D.with_ctes(D.RELATIONS_SQL, body="""
SELECT relation_id, concat_ws(',', CASE WHEN n % 10 = 0 THEN 'invalid_kind' END, CASE WHEN n % 9 = 0 OR (n % 8 <> 0 AND to_version NOT IN (SELECT 'v' || doc_id FROM documents)) THEN 'unavailable_upstream' END,
  CASE WHEN status = 'direct' AND n % 9 <> 0 AND n % 8 = 0 THEN 'direct_without_target' END, CASE WHEN n % 6 = 0 THEN 'empty_basis' END) AS reasons
FROM (SELECT *, CAST(substr(relation_id, 2) AS BIGINT) AS n FROM relations)"""))
def relation_output(t):
    """Relation rows of a plug-in: vocabulary, endpoints and the basis rule."""
    n = F.substring("relation_id", 2, 20).cast("long")
    r = D.relations(t).withColumns({"to_version": F.when(n % 9 == 0, "v?").when(n % 8 == 0, F.lit(None)).otherwise(F.col("to_version")),
                                    "kind": F.when(n % 10 == 0, "rumours").otherwise(F.col("kind"))})
    m = D.materials(t)
    middle = F.floor(F.length("content") / 2).cast("int")
    spans = r.filter(n % 6 != 0).join(m.select(F.col("version_id").alias("from_version"), "content"), "from_version").select(
        F.col("relation_id").alias("finding_id"), F.col("from_version").alias("version_id"), middle.alias("start"), (middle + 1).alias("end"),
        F.col("content").substr(middle + 1, F.lit(1)).alias("quote"))
    return P.relation_codes(r, spans, m).withColumn("reasons", F.array_join("reasons", ","))


@query("P5", D.with_ctes(D.ORIGINS_SQL, body="""
SELECT version_id, concat_ws(',', CASE WHEN d.source = 'src0' THEN 'invalid_kind' END, CASE WHEN trim(d.lang) = 'de' THEN 'empty_rationale' END) AS reasons
FROM origins o JOIN documents d ON o.version_id = 'v' || d.doc_id"""))
def origin_output(t):
    """Origin rows of a plug-in: an explicit original kind and a rationale."""
    d = t("documents").select(D.vid(F.col("doc_id")).alias("version_id"), "source", "lang")
    o = D.origins(t).join(d, "version_id").select(
        "version_id", F.when(F.col("source") == "src0", "hearsay").otherwise(F.col("material_kind")).alias("material_kind"),
        F.when(F.col("lang") == "de", "  ").otherwise("names its own record").alias("rationale"))
    return P.origin_codes(o).withColumn("reasons", F.array_join("reasons", ","))


def _majority(frame: pd.DataFrame) -> pd.DataFrame:
    """A verifier: more supporting than contradicting versions decide the target."""
    n = frame.set_index("stance")["versions"]
    s, x = int(n.get("supports", 0)), int(n.get("contradicts", 0))
    verdict = "supported" if s > x else "contradicted" if x > s else "unresolved"
    return pd.DataFrame([{"target_id": frame["target_id"].iloc[0], "verdict": verdict, "evidence_count": s + x, "rationale": "majority"}])


@query("P4 P6", """
WITH s AS (SELECT 'p' || (doc_id // 21) AS target_id, count(*) FILTER (quality = 1) AS s, count(*) FILTER (quality = 0) AS x FROM labels GROUP BY ALL)
SELECT 'p' || k AS target_id, CASE WHEN s > x THEN 'supported' WHEN x > s THEN 'contradicted' ELSE 'unresolved' END AS verdict
FROM (SELECT DISTINCT doc_id // 21 AS k FROM documents) d LEFT JOIN s ON s.target_id = 'p' || k""")
def verifier_output(t):
    """A Python verifier per target on bounded summaries, replayed over all targets as annotations."""
    d = t("documents").select("doc_id", F.concat(F.lit("p"), F.floor(F.col("doc_id") / 21)).alias("target_id"))
    stances = t("labels").select(F.col("doc_id").alias("version_id"), F.when(F.col("quality") == 1, "supports").otherwise("contradicts").alias("stance"))
    summary = P.verdict_summary(d.withColumnRenamed("doc_id", "version_id"), stances)
    verdicts = P.verify(summary, _majority).select("target_id", "verdict")
    return P.annotated(d.select("target_id").distinct(), verdicts, ["target_id"])


@query("F36 U4", D.with_ctes(D.GAP_EVENTS_SQL, body="""
, st AS (SELECT target_id, gap_id, coalesce(max(epoch) FILTER (op = 'open'), -1) > coalesce(max(epoch) FILTER (op = 'close'), -1) AS open FROM gap_events GROUP BY ALL)
SELECT target_id, count(*) AS gaps, count(*) FILTER (open) AS open FROM st GROUP BY target_id""".replace("\n, st AS", ", st AS", 1)))
def open_gap_union(t):
    """Union of findings across owners with the current number of open gaps per target."""
    e = D.gap_events(t)
    owners = [e.filter(F.col("owner") == f"owner{n}") for n in range(3)]
    union = owners[0].unionByName(owners[1]).unionByName(owners[2])
    return S.gap_state(union).groupBy("target_id").agg(F.count(F.lit(1)).alias("gaps"), F.count_if(F.col("state") == "open").alias("open"))
