"""Lineage graph queries over relations, origins and links derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage as L
from . import derive as D
from .registry import query

_DIRECT = D.RELATIONS_SQL + """, direct AS (SELECT * FROM relations WHERE status = 'direct' AND kind <> 'supports')"""
# A shortest way is shorter than 40 edges at these sizes; longer walks go round a cycle.
_WALK = _DIRECT + """, walk AS (SELECT 'v' || doc_id AS start, 'v' || doc_id AS node, 0 AS hops FROM documents
  UNION SELECT w.start, d.to_version, w.hops + 1 FROM walk w JOIN direct d ON d.from_version = w.node AND d.from_version <> d.to_version WHERE w.hops < 40)"""


@query("G3", D.with_ctes(_WALK, body="""
SELECT start, count(*) AS reached, max(hops)::BIGINT AS hops FROM (SELECT start, node, min(hops) AS hops FROM walk GROUP BY ALL) GROUP BY start"""))
def reachability(t):
    """Nodes reachable from every version over direct lineage."""
    links = L.direct_lineage(D.relations(t)).select(F.lit(0).alias("scope"), F.col("from_version").alias("src"), F.col("to_version").alias("dst"))
    starts = t("documents").select(F.lit(0).alias("scope"), D.vid(F.col("doc_id")).alias("start"))
    return L.reach(starts, links).groupBy("start").agg(F.count(F.lit(1)).alias("reached"), F.max("hops").cast("long").alias("hops"))


@query("G4", D.with_ctes(_WALK, D.ORIGINS_SQL, body="""
SELECT start AS source_version_id, bool_or(node IN (SELECT version_id FROM origins)) AS has_origin FROM walk GROUP BY start"""))
def origin_path(t):
    """Whether each target's source reaches an original over direct lineage."""
    targets = t("documents").select(D.vid(F.col("doc_id")).alias("source_version_id"))
    return L.origin_reached(targets, D.relations(t), D.origins(t))


def located(t, targets):
    """Originals of ``targets`` over the edges that were observed or bound by a citation."""
    i = F.substring("relation_id", 2, 20).cast("long")
    r = D.relations(t).withColumns({"to_url_key": F.col("to_version"), "quotes_from": F.lit(True), "quotes_to": i % 2 == 0})
    observed = D.relations(t).filter(i % 3 != 0).select(F.col("from_version").alias("version_id"), F.col("to_version").alias("link_key"))
    citations = D.relations(t).filter("kind = 'cites'").select("from_version", "to_version")
    return L.located_origins(targets, r, D.origins(t), observed, citations)


@query("G5 J11 A28", D.with_ctes(D.RELATIONS_SQL, D.ORIGINS_SQL, body="""
, adm AS (SELECT * FROM relations WHERE status = 'direct' AND kind <> 'supports' AND (CAST(substr(relation_id, 2) AS BIGINT) % 3 <> 0
    OR (kind = 'cites' AND CAST(substr(relation_id, 2) AS BIGINT) % 2 = 0))),
w AS (SELECT 'v' || doc_id AS start, 'v' || doc_id AS node FROM documents UNION SELECT w.start, a.to_version FROM w JOIN adm a ON a.from_version = w.node),
loc AS (SELECT start, node, material_kind FROM w JOIN origins o ON o.version_id = w.node)
SELECT node AS version_id, material_kind, count(*) AS claims FROM loc GROUP BY ALL""".replace("\n, adm AS", ", adm AS", 1)))
def located_origins(t):
    """Originals reached over observed or citation-bound edges, with the number of claims each serves."""
    out = located(t, t("documents").select(D.vid(F.col("doc_id")).alias("source_version_id")))
    return out.groupBy("version_id", "material_kind").agg(F.count(F.lit(1)).alias("claims"))


@query("J11", D.with_ctes(D.RELATIONS_SQL, body="""
SELECT kind, count(*) AS edges, count(*) FILTER (n % 3 <> 0) AS observed, count(*) FILTER (n % 3 <> 0 OR (kind = 'cites' AND n % 2 = 0)) AS admitted
FROM (SELECT *, CAST(substr(relation_id, 2) AS BIGINT) AS n FROM relations) GROUP BY kind"""))
def edge_admission(t):
    """Edges admitted by an observed link or a bound citation pair, by kind."""
    i = F.substring("relation_id", 2, 20).cast("long")
    r = D.relations(t).withColumns({"to_url_key": F.col("to_version"), "quotes_from": F.lit(True), "quotes_to": i % 2 == 0})
    observed = r.filter(i % 3 != 0).select(F.col("from_version").alias("version_id"), F.col("to_version").alias("link_key"))
    ok = L.admitted_edges(r, observed, r.filter("kind = 'cites'").select("from_version", "to_version"))
    seen = r.join(observed.select(F.col("version_id").alias("from_version"), F.col("link_key").alias("to_url_key"), F.lit(1).alias("_s")).distinct(),
                  ["from_version", "to_url_key"], "left")
    marked = seen.join(ok.select("relation_id", F.lit(1).alias("_a")), "relation_id", "left")
    return marked.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count("_s").alias("observed"), F.count("_a").alias("admitted"))


@query("G13", D.with_ctes(_DIRECT, D.ORIGINS_SQL, body="""
, p AS (SELECT 'v' || doc_id AS start, 'v' || doc_id AS node, '' AS path, 0 AS hops FROM documents
  UNION ALL SELECT p.start, d.to_version, p.path || ',' || d.relation_id, p.hops + 1 FROM p JOIN direct d ON d.from_version = p.node AND d.from_version <> d.to_version WHERE p.hops < 25)
SELECT start, arg_min(node, (hops, path)) AS origin, arg_min(path, (hops, path)) AS path FROM p WHERE node IN (SELECT version_id FROM origins) GROUP BY start
""".replace("\n, p AS", ", p AS", 1)))
def origin_path_edges(t):
    """Shortest path to an original with the edge ids used."""
    links = L.direct_lineage(D.relations(t)).select(F.col("from_version").alias("src"), F.col("to_version").alias("dst"), F.col("relation_id").alias("edge_id"))
    found = L.nearest(D.origins(t).select(F.lit(0).alias("scope"), F.col("version_id").alias("node")), links)
    starts = t("documents").select(D.vid(F.col("doc_id")).alias("node"))
    return found.join(starts, "node", "left_semi").select(F.col("node").alias("start"), F.col("goal").alias("origin"), F.concat(
        F.when(F.col("steps") > 0, ",").otherwise(""), F.array_join("path", ",")).alias("path"))


@query("G6", """
WITH RECURSIVE n AS (SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN -1 WHEN doc_id % 19 = 0 THEN doc_id + 1 WHEN doc_id % 19 = 1 THEN doc_id - 1 ELSE doc_id // 2 END AS up FROM documents WHERE doc_id > 0),
good AS (SELECT 0::BIGINT AS id UNION SELECT n.id FROM n JOIN good g ON n.up = g.id)
SELECT n.id, n.id IN (SELECT id FROM good) AS valid FROM n""")
def tree_validity(t):
    """Fragments whose parents form an acyclic path to the target."""
    i = F.col("doc_id")
    nodes = t("documents").filter(i > 0).select(
        F.lit(0).alias("scope"), i.alias("id"), F.when(i % 17 == 0, -1).when(i % 19 == 0, i + 1).when(i % 19 == 1, i - 1).otherwise(F.floor(i / 2)).alias("parent_id"))
    return L.tree_paths(nodes, F.lit(0).cast("long")).select("id", "valid")


@query("G10", """
WITH RECURSIVE f AS (SELECT doc_id AS id, 0 AS depth, doc_id::VARCHAR AS path FROM documents WHERE doc_id = 0
  UNION ALL SELECT d.doc_id, f.depth + 1, f.path || '/' || d.doc_id FROM documents d JOIN f ON d.doc_id // 3 = f.id AND d.doc_id > 0)
SELECT id, depth::BIGINT AS depth, path FROM f""")
def event_tree(t):
    """Event tree flattened from parent pointers, with depth and path."""
    i = F.col("doc_id")
    nodes = t("documents").select(F.lit(0).alias("scope"), i.cast("string").alias("id"), F.when(i > 0, F.floor(i / 3)).cast("string").alias("parent_id"))
    return L.flatten_tree(nodes).select(F.col("id").cast("long").alias("id"), F.col("depth").cast("long").alias("depth"), "path")


@query("G9", """
WITH m AS (SELECT doc_id, md5(text) AS fp, lang, first_value(doc_id) OVER (PARTITION BY lang, md5(text) ORDER BY (doc_id % 10 = 7) DESC, doc_id) AS rep FROM documents)
SELECT 'v' || doc_id AS version_id, 'v' || rep AS representative FROM m WHERE doc_id <> rep""")
def alias_dedup(t):
    """Versions with the same content under another id; a seed represents its group."""
    i = F.col("doc_id")
    m = t("documents").select(D.vid(i).alias("version_id"), "text", "lang", i.alias("position"))
    return L.version_aliases(m, F.md5("text"), F.col("position") % 10 == 7, ["lang"]).select("version_id", "representative")


@query("G12", """
WITH RECURSIVE req AS (SELECT doc_id AS a, doc_id // 2 AS b FROM documents WHERE doc_id > 0 UNION ALL SELECT doc_id, doc_id // 3 FROM documents WHERE doc_id > 0),
st AS (SELECT source AS scope, max(doc_id) AS node FROM documents GROUP BY source),
w AS (SELECT scope, node FROM st UNION SELECT w.scope, r.b FROM w JOIN req r ON r.a = w.node),
q AS (SELECT w.scope, count(*) AS requests FROM w JOIN req r ON r.a = w.node GROUP BY w.scope)
SELECT w.scope, count(*) AS visited, any_value(q.requests) - (count(*) - 1) AS repeats FROM w JOIN q ON q.scope = w.scope GROUP BY w.scope""")
def revisit_cascade(t):
    """Reanalysis requests followed from one start per source; repeated requests are logged."""
    i = F.col("doc_id")
    d = t("documents").filter(i > 0)
    requests = d.select(i.alias("from_version"), F.floor(i / 2).alias("to_version")).unionAll(d.select(i, F.floor(i / 3)))
    starts = t("documents").groupBy(F.col("source").alias("scope")).agg(F.max("doc_id").alias("version_id"))
    visited, log = L.revisit_cascade(requests, starts)
    n = visited.groupBy("scope").agg(F.count(F.lit(1)).alias("visited"))
    r = log.groupBy("scope").agg(F.sum("repeats").alias("repeats"))
    return n.join(r, "scope", "left").fillna(0, ["repeats"])


@query("J13", D.with_ctes(D.RELATIONS_SQL, D.MATERIALS_SQL, body="""
, w AS (SELECT relation_id, from_version, CASE WHEN n % 2 = 0 THEN 'v' || (n // 2) ELSE 'https://pub' || ((n // 2) % 7) || '.example.org/a/' || ((n // 2) // 21) END AS loc
  FROM (SELECT *, CAST(substr(relation_id, 2) AS BIGINT) AS n FROM relations) WHERE status = 'declared')
SELECT DISTINCT w.relation_id, m.version_id AS upstream_version FROM w JOIN materials m ON (m.version_id = loc OR m.url = loc) AND m.version_id <> w.from_version
""".replace("\n, w AS", ", w AS", 1)))
def upstream_arrivals(t):
    """Declared edges without a target that a version answers by address or id."""
    n = F.substring("relation_id", 2, 20).cast("long")
    up = F.floor(n / 2)
    loc = F.when(n % 2 == 0, D.vid(up)).otherwise(F.concat(F.lit("https://pub"), (up % 7).cast("string"), F.lit(".example.org/a/"), F.floor(up / 21)))
    waiting = D.relations(t).filter("status = 'declared'").select("relation_id", "from_version", F.lit(None).cast("string").alias("to_version"), loc.alias("upstream_locator"))
    return L.upstream_arrivals(waiting, D.materials(t)).select("relation_id", "upstream_version").distinct()


@query("J23", D.with_ctes(D.MATERIALS_SQL, body="""
, c AS (SELECT doc_id, version_id AS f, CASE doc_id % 3 WHEN 0 THEN 'v' || (doc_id + 1) WHEN 1 THEN url ELSE 'ministry of ' || doc_id END AS locator FROM materials),
n AS (SELECT url AS locator, version_id FROM materials UNION SELECT version_id, version_id FROM materials),
p AS (SELECT locator, count(*) AS k, min(version_id) AS one FROM n GROUP BY locator)
SELECT c.doc_id, coalesce(k, 0) AS matches, CASE WHEN k = 1 AND one <> f THEN one END AS to_version, CASE WHEN k = 1 AND one <> f THEN 'direct' ELSE 'declared' END AS status,
  CASE WHEN k = 1 AND one <> f THEN NULL WHEN c.locator LIKE 'https://%' THEN 'fetch' ELSE 'search' END AS task_action FROM c LEFT JOIN p ON p.locator = c.locator
""".replace("\n, c AS", ", c AS", 1)))
def edge_resolution(t):
    """Citation locators: one visible match gives a direct edge, otherwise a task."""
    m, i = D.materials(t), F.col("doc_id")
    loc = F.when(i % 3 == 0, D.vid(i + 1)).when(i % 3 == 1, F.col("url")).otherwise(F.concat(F.lit("ministry of "), i))
    c = m.select("doc_id", F.col("version_id").alias("from_version"), loc.alias("locator"))
    return L.resolve_citations(c, m).select("doc_id", "matches", "to_version", "status", "task_action")


@query("F40", """
WITH p AS (SELECT c_custkey, 'c' || c_custkey AS c, 'n' || c_nationkey AS n, 'r' || n_regionkey AS r, n_nationkey AS k FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT DISTINCT 'n' || s_nationkey AS n FROM supplier)
SELECT c_custkey, concat_ws(',', CASE WHEN k = 7 THEN 'unfetched_source' END, CASE WHEN c_custkey % 11 = 0 THEN 'wrong_start' END,
  CASE WHEN c_custkey % 13 = 0 THEN 'repeated_step' END,
  CASE WHEN (k = 7 OR n NOT IN (SELECT n FROM s)) OR c_custkey % 13 = 0 THEN 'unobserved_step' END,
  CASE WHEN c_custkey % 17 = 0 OR c_custkey % 13 = 0 THEN 'wrong_end' END) AS reasons FROM p""")
def chain_check(t):
    """Origin chains from customer to nation to region against observed steps."""
    i = F.col("c_custkey")
    p = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    c, n, r = F.concat(F.lit("c"), i), F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("r"), "n_regionkey")
    alias = F.concat(F.lit("n-old"), "c_nationkey")
    steps = F.when(i % 13 == 0, F.array(c, n, alias, c)).otherwise(F.array(c, n, alias, r))
    chains = p.select(i.alias("chain_id"), F.when(i % 11 == 0, "elsewhere").otherwise(c).alias("input_key"),
                      F.when(i % 17 == 0, "elsewhere").otherwise(r).alias("origin_key"), steps.alias("steps"))
    keys = p.select(F.explode(F.array(c, n, r)).alias("key")).distinct().filter("key <> 'n7'")
    supplied = t("supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("b")).distinct().filter("b <> 'n7'")
    first = p.select(c.alias("a"), n.alias("b")).join(supplied, "b", "left_semi").select("a", "b")
    second = p.select(n.alias("a"), r.alias("b")).distinct()
    aliases = p.select(alias.alias("key"), n.alias("to_key")).distinct()
    out = L.chain_codes(chains, first.unionByName(second), keys, aliases)
    return out.select(F.col("chain_id").alias("c_custkey"), F.array_join("reasons", ",").alias("reasons"))


@query("G7", """
WITH n AS (SELECT count(*) AS c FROM documents),
l AS (SELECT doc_id AS p, j AS pos, (doc_id * 3 + j * j + 1) % n.c AS k, CASE WHEN (doc_id + j) % 3 = 0 THEN 1 ELSE 0 END AS likely FROM documents, n, (VALUES (0), (1), (2), (3)) v(j)),
f1 AS (SELECT d.doc_id AS s, k, min((p::BIGINT * 10 + pos)) AS first_at, max(likely) AS likely FROM documents d JOIN l ON l.p = d.doc_id WHERE k <> d.doc_id GROUP BY ALL),
c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY likely DESC, first_at, k) AS rn FROM f1) WHERE rn <= 2),
f2 AS (SELECT c1.s, l.k, min((l.p::BIGINT * 10 + l.pos)) AS first_at, max(l.likely) AS likely FROM c1 JOIN l ON l.p = c1.k WHERE l.k <> c1.s
  AND NOT EXISTS (SELECT 1 FROM c1 x WHERE x.s = c1.s AND x.k = l.k) GROUP BY ALL),
c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY likely DESC, first_at, k) AS rn FROM f2) WHERE rn <= 2)
SELECT s AS scope, 1::BIGINT AS depth, k AS key FROM c1 UNION ALL SELECT s, 2, k FROM c2""")
def link_frontier(t):
    """Two levels of unseen links from every page of a link graph, source-like links first."""
    d = t("documents").select("doc_id")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    i, j = F.col("doc_id"), F.col("j")
    links = d.join(F.broadcast(n)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        i.alias("page_key"), j.alias("pos"), ((i * 3 + j * j + 1) % F.col("n")).alias("link_key"),
        F.when((i + j) % 3 == 0, "a study").otherwise("home").alias("text"))
    seeds = d.select(i.alias("scope"), i.alias("page_key"))
    return L.link_frontier(seeds, links, 2).select("scope", F.col("depth").cast("long").alias("depth"), "key")


@query("A28", """
SELECT conv_id AS item, count(*) AS claims, count(*) FILTER (length(text) % 3 = 0) AS located,
  CASE WHEN count(*) FILTER (length(text) % 3 = 0) = count(*) THEN 'located' WHEN count(*) FILTER (length(text) % 3 = 0) > 0 THEN 'partial' ELSE 'unresolved' END AS status
FROM conversations GROUP BY conv_id""")
def origin_summary(t):
    """Located, partial or unresolved per item over its claims."""
    return origin_status(t("conversations").select(F.col("conv_id").alias("item"), (F.length("text") % 3 == 0).alias("hit")))


@query("A28 G5", D.with_ctes(D.RELATIONS_SQL, D.ORIGINS_SQL, D.MATERIALS_SQL, body="""
, adm AS (SELECT * FROM relations WHERE status = 'direct' AND kind <> 'supports' AND (CAST(substr(relation_id, 2) AS BIGINT) % 3 <> 0
    OR (kind = 'cites' AND CAST(substr(relation_id, 2) AS BIGINT) % 2 = 0))),
w AS (SELECT 'v' || doc_id AS start, 'v' || doc_id AS node FROM documents UNION SELECT w.start, a.to_version FROM w JOIN adm a ON a.from_version = w.node),
loc AS (SELECT DISTINCT m0.pool_id, 'c' || m0.doc_id AS claim_id, m.url, o.version_id, o.material_kind FROM w JOIN origins o ON o.version_id = w.node
  JOIN materials m ON m.version_id = o.version_id JOIN materials m0 ON m0.version_id = w.start),
st AS (SELECT m.pool_id, count(*) AS claims, count(l.claim_id) AS located FROM materials m LEFT JOIN (SELECT DISTINCT claim_id FROM loc) l ON l.claim_id = 'c' || m.doc_id GROUP BY m.pool_id)
SELECT st.pool_id AS item, CASE WHEN located = claims THEN 'located' WHEN located > 0 THEN 'partial' ELSE 'unresolved' END AS status, claims, located,
  url, version_id, material_kind, claim_ids FROM st LEFT JOIN (SELECT pool_id, url, version_id, material_kind, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids
  FROM loc GROUP BY ALL) s ON s.pool_id = st.pool_id""".replace("\n, adm AS", ", adm AS", 1)))
def origin_sources(t):
    """Status of every item and its distinct sources, each with the ids of the claims it serves."""
    m, i = D.materials(t), F.col("doc_id")
    claims = m.select(F.col("pool_id").alias("item"), F.concat(F.lit("c"), i).alias("claim_id"), F.col("version_id").alias("source_version_id"))
    found = located(t, claims.select("item", "claim_id", "source_version_id")).join(m.select("version_id", "url"), "version_id")
    return L.origin_summary(claims, found).withColumn("claim_ids", F.array_join("claim_ids", ","))


def origin_status(claims):
    """Status of an item from its claims: all, some or none located."""
    per = claims.groupBy("item").agg(F.count(F.lit(1)).alias("claims"), F.count_if("hit").alias("located"))
    return per.withColumn("status", F.when(F.col("located") == F.col("claims"), "located").when(F.col("located") > 0, "partial").otherwise("unresolved"))
