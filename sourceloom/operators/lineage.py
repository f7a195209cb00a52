"""Lineage graph: reachability, origin paths, trees, link frontiers, edge admission."""

from __future__ import annotations

from itertools import count
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..functions.urls import url_key
from ..session import cut, cut_counted, written
from .skew import hub_lookup, top_k

# Relation kinds that carry lineage, and the originals a finding may name.
LINEAGE_KINDS = ["quotes", "cites", "reprints", "translates", "derives"]
RELATION_KINDS = LINEAGE_KINDS + ["supports", "contradicts"]
RELATION_STATUS = ["direct", "declared", "inferred", "unresolved", "excluded"]
ORIGINAL_KINDS = ["original_record", "original_interview", "original_dataset", "original_observation"]
OPEN_PASSES = 6
SOURCE_LIKE = ["source", "study", "report", "doi.org", "research", "原文", "来源", "研究"]


def direct_lineage(relations: DataFrame) -> DataFrame:
    return relations.filter((F.col("status") == "direct") & F.col("kind").isin(LINEAGE_KINDS) & F.col("to_version").isNotNull())


def reach(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes reachable from each (scope, start), with the first hop count.

    Frontier join: a pass extends only rows found by the pass before, drops the
    visited ones and is written to the checkpoint folder.
    """
    links = cut(edges.select("scope", "src", "dst").distinct())
    seen = cut(starts.select("scope", "start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct())
    frontier = seen
    for hop in count(1):
        step = frontier.join(links.hint("merge"), (frontier["scope"] == links["scope"]) & (frontier["node"] == links["src"])).select(
            frontier["scope"], frontier["start"], F.col("dst").alias("node"), F.lit(hop).alias("hops")).distinct()
        frontier = cut(step.join(seen.hint("merge"), ["scope", "start", "node"], "left_anti").select("scope", "start", "node", "hops"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if hop % 8 == 0:
            seen = cut(seen)


def _gathered(rows: DataFrame) -> DataFrame:
    """Unions of a loop in the usual number of partitions: otherwise each pass would add to it."""
    return rows.coalesce(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _ending(rows: DataFrame, total: int) -> DataFrame:
    """(node): the at most ``total`` open rows of ``chains`` that come to an end; others lead into a closed round.  Only pointers are doubled here."""
    state = rows.select("node", "up", F.lit(False).alias("done"))
    for _ in range(ceil(log2(max(total, 2))) + 1):
        if state.filter("NOT done").isEmpty():
            break
        table = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("done").alias("_done"))
        moved = hub_lookup(state.filter("NOT done"), "up", table, total).select(
            "node", F.coalesce("_up", "up").alias("up"), F.coalesce("_done", F.lit(True)).alias("done"))
        state = written(_gathered(state.filter("done").unionByName(moved)))
    return state.filter("done").select("node")


def chains(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Where the nodes with one way on lead: (node, end, steps, path), by pointer doubling.

    ``edges(src, dst, edge_id)`` with one row per (src, dst), ``keep(node)``.  A node with exactly one edge that is not kept goes where
    that edge goes, so whatever is asked about it is answered at the first node that is kept, has several edges or none.  After k passes
    a row points 2^k edges on, and steps and edge ids are joined as pointers jump.  ``end`` is null on a closed round, which leads nowhere;
    what is still open after ``OPEN_PASSES`` is asked whether it ends before its edge ids are joined further: a round would double them for ever.
    """
    one = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_n"), F.min("dst").alias("up"), F.min("edge_id").alias("_e")).filter("_n = 1")
    first = one.join(keep.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti").select(
        F.col("src").alias("node"), "up", F.lit(1).cast("long").alias("steps"), F.array_compact(F.array("_e")).alias("path"), F.lit(False).alias("done"))
    state, (total, _) = cut_counted(first, "node")
    rounds = None
    for turn in range(1, ceil(log2(max(total, 2))) + 2):
        # pointers that have arrived stay out of the lookup
        table = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("path").alias("_path"),
                             F.col("done").alias("_done"))
        moved = hub_lookup(state.filter("NOT done"), "up", table, total).select(
            "node", F.coalesce("_up", "up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.when(F.col("_up").isNull(), F.col("path")).otherwise(F.concat("path", "_path")).alias("path"),
            F.coalesce("_done", F.lit(True)).alias("done"))
        state = written(_gathered(state.filter("done").unionByName(moved)))
        still = state.filter("NOT done")
        if still.isEmpty():
            break
        if turn == OPEN_PASSES:
            # what a done row points at is an end, so an open row that reaches one meets no row there
            ends = _ending(still, total)
            rounds = still.join(ends.hint("merge"), "node", "left_anti").select("node", "steps")
            state = written(_gathered(state.filter("done").unionByName(still.join(ends.hint("merge"), "node", "left_semi").select(state.columns))))
            if state.filter("NOT done").isEmpty():
                break
    out = state.select("node", F.when(F.col("done"), F.col("up")).alias("end"), "steps", F.when(F.col("done"), F.col("path")).alias("path"))
    if rounds is None:
        return out
    return out.unionByName(rounds.select("node", F.lit(None).cast(edges.schema["dst"].dataType).alias("end"), "steps",
                                         F.lit(None).cast("array<string>").alias("path")))


def contracted(edges: DataFrame, led: DataFrame, total: int) -> DataFrame:
    """(src, dst, steps, path): the edges of the nodes that ``chains`` leaves, each followed to where it leads."""
    bare = edges.join(led.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti")
    table = led.select(F.col("node").alias("dst"), "end", F.col("steps").alias("_steps"), F.col("path").alias("_path"), F.lit(True).alias("_led"))
    followed = hub_lookup(bare, "dst", table, total).filter("_led IS NULL OR end IS NOT NULL").select(
        "src", F.coalesce("end", "dst").alias("dst"), F.struct(
            (F.coalesce("_steps", F.lit(0)) + 1).alias("steps"),
            F.concat(F.array_compact(F.array("edge_id")), F.coalesce("_path", F.array().cast("array<string>"))).alias("path")).alias("w"))
    return followed.filter("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")).select("src", "dst", "w.steps", "w.path")


def single_edges(edges: DataFrame) -> tuple[DataFrame, int]:
    """One edge per (src, dst), that of the smallest id, without loops; and their number.  Without ``edge_id`` paths stay empty."""
    named = edges if "edge_id" in edges.columns else edges.withColumn("edge_id", F.lit(None).cast("string"))
    out, (n, _) = cut_counted(named.filter("src <> dst").groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id")), "src", "dst")
    return out, n


def nearest(goals: DataFrame, edges: DataFrame) -> DataFrame:
    """Nearest goal of every node that reaches one: (scope, node, goal, steps, path), one row per scope and node.

    ``goals(scope, node)``, ``edges(src, dst[, edge_id])``.  Of shortest ways the one with the smallest edge ids wins.  Chains are contracted first,
    in a logarithmic number of passes; then rows are improved backwards from the goals over the contracted edges, one pass per branching on
    the way.  There is no row per (node, node) pair.  A goal's own row has no steps.
    """
    edges, n = single_edges(edges)
    goals = goals.select("scope", "node").distinct()
    led = written(chains(edges, goals.select("node").distinct()))
    hops, (total, _) = cut_counted(contracted(edges, led, n), "src", "dst")
    best = written(goals.select("scope", "node", F.struct(F.lit(0).cast("long").alias("steps"), F.array().cast("array<string>").alias("path"),
                                                      F.col("node").alias("goal")).alias("b")))
    frontier = best  # ``best`` may hold several rows of a node: the smallest counts
    for turn in count(1):
        step = hops.join(frontier.withColumnRenamed("node", "dst").hint("merge"), "dst").select("scope", F.col("src").alias("node"), F.struct(
            (F.col("b.steps") + F.col("steps")).alias("steps"), F.concat("path", "b.path").alias("path"), "b.goal").alias("b"))
        found = step.groupBy("scope", "node").agg(F.min("b").alias("b"))
        known = (found["scope"] == best["scope"]) & (found["node"] == best["node"]) & (best["b"] <= found["b"])
        frontier = written(_gathered(found.join(best.hint("merge"), known, "left_anti")))
        done = frontier.isEmpty()
        best = best.unionByName(frontier)
        if done or turn % 8 == 0:
            best = written(_gathered(best.groupBy("scope", "node").agg(F.min("b").alias("b"))))
        if done:
            break
    on_chains = led.filter("end IS NOT NULL").join(best.withColumnRenamed("node", "end").hint("merge"), "end").select(
        "scope", "node", F.col("b.goal").alias("goal"), (F.col("steps") + F.col("b.steps")).alias("steps"), F.concat("path", "b.path").alias("path"))
    return best.select("scope", "node", "b.goal", "b.steps", "b.path").unionByName(on_chains)


def origin_reached(targets: DataFrame, relations: DataFrame, origins: DataFrame) -> DataFrame:
    """Targets flagged by whether their source reaches an original over direct lineage.

    The question is the same for every target of one source version, so it is
    answered once per version and the targets look their source up.
    """
    links = direct_lineage(relations).select(F.col("from_version").alias("src"), F.col("to_version").alias("dst"))
    good = nearest(origins.select(F.lit(0).alias("scope"), F.col("version_id").alias("node")), links)
    hit = good.select(F.col("node").alias("source_version_id"), F.lit(True).alias("_hit"))
    return targets.join(hit.hint("merge"), "source_version_id", "left").withColumn("has_origin", F.coalesce("_hit", F.lit(False))).drop("_hit")


def located_origins(targets: DataFrame, relations: DataFrame, origins: DataFrame, observed: DataFrame,
                    citations: DataFrame) -> DataFrame:
    """Originals each target reaches over edges that were observed or citation-bound."""
    admitted = admitted_edges(direct_lineage(relations), observed, citations)
    edges, n = single_edges(admitted.select(F.col("from_version").alias("src"), F.col("to_version").alias("dst")))
    led = written(chains(edges, origins.select(F.col("version_id").alias("node")).distinct()))
    # a start on a chain reaches what the end of its chain reaches; only these ends are walked from, over contracted edges
    starts = cut(targets.select(F.col("source_version_id").alias("node")).distinct().join(led.hint("merge"), "node", "left").filter("steps IS NULL OR end IS NOT NULL").select(
        F.col("node").alias("source_version_id"), F.coalesce("end", "node").alias("start")))
    scope = F.lit(0).alias("scope")
    found = reach(starts.select(scope, "start").distinct(), contracted(edges, led, n).select(scope, "src", "dst")).join(
        origins.withColumnRenamed("version_id", "node").hint("merge"), "node").select("start", F.col("node").alias("version_id"), "material_kind")
    return targets.join(starts.join(found.hint("merge"), "start").drop("start").hint("merge"), "source_version_id")


def origin_summary(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Status of each item and its distinct (url, version_id, material_kind) sources with merged, sorted claim ids.

    ``claims(item, claim_id)``, ``found(item, claim_id, url, version_id, material_kind)``.  An item is located when each of its claims
    is, partial when some are; an unresolved item is one row without a source.  An array holds claims of one item only, and
    these are capped per item (``retrieval.split_capped``), however many items share a source.
    """
    rows = found.select("item", "claim_id", "url", "version_id", "material_kind").distinct()
    hit = rows.select("item", "claim_id").distinct().withColumn("_hit", F.lit(1))
    per = claims.select("item", "claim_id").distinct().join(hit, ["item", "claim_id"], "left").groupBy("item").agg(
        F.count(F.lit(1)).alias("claims"), F.count("_hit").alias("located"))
    status = F.when(F.col("located") == F.col("claims"), "located").when(F.col("located") > 0, "partial").otherwise("unresolved")
    sources = rows.groupBy("item", "url", "version_id", "material_kind").agg(F.sort_array(F.collect_list("claim_id")).alias("claim_ids"))
    return per.select("item", status.alias("status"), "claims", "located").join(sources, "item", "left")


def admitted_edges(relations: DataFrame, observed: DataFrame, citations: DataFrame) -> DataFrame:
    """Edges whose target address was seen on the source page, or cites edges with a bound citation
    pair and quotes from both ends.

    ``relations`` carries to_url_key, quotes_from and quotes_to.
    """
    seen = relations.join(observed.select(F.col("version_id").alias("from_version"), F.col("link_key").alias("to_url_key")).distinct().hint("merge"),
                          ["from_version", "to_url_key"], "left_semi")
    bound = relations.filter((F.col("kind") == "cites") & F.col("quotes_from") & F.col("quotes_to")).join(
        citations.select("from_version", "to_version").distinct().hint("merge"), ["from_version", "to_version"], "left_semi")
    return seen.unionByName(bound.select(*seen.columns)).distinct()


def tree_paths(nodes: DataFrame, root: Column) -> DataFrame:
    """Which nodes of a parent table lead to the root without a cycle or a gap.

    Pointer doubling: after k passes a row points 2^k parents up, so the number
    of passes is the logarithm of the row count.
    """
    rows = nodes.select("scope", "id", F.col("parent_id").alias("up"), root.alias("root"))
    state = cut(rows)
    total = state.count()
    # ``up`` ends at the root, at null (missing parent), or circles for ever.
    open_rows = F.coalesce(F.col("up") != F.col("root"), F.lit(False))
    for _ in range(ceil(log2(max(total, 2))) + 1):
        parents = state.select(F.col("scope").alias("_scope"), F.col("id").alias("_id"), F.col("up").alias("_up"))
        # finished rows stay out of the join, where they would all meet at the root's key
        moved = state.filter(open_rows).join(parents, (F.col("scope") == F.col("_scope")) & (F.col("up") == F.col("_id")), "left")
        state = cut(state.filter(~open_rows).unionByName(moved.select("scope", "id", F.col("_up").alias("up"), "root")))
        if state.filter(open_rows).isEmpty():
            break
    return state.select("scope", "id", F.coalesce(F.col("up") == F.col("root"), F.lit(False)).alias("valid"))


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """Depth and slash path of every node under its root, by pointer doubling: a logarithmic number of passes.

    Nodes below a missing parent or on a closed round hang under no root and have no row.
    """
    key = F.struct("scope", "id")
    first = nodes.select(key.alias("node"), F.when(F.col("parent_id").isNotNull(), F.struct("scope", F.col("parent_id").alias("id"))).alias("up"),
                         F.col("id").alias("path"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"))
    state, (total, _) = cut_counted(first, "node")
    for _ in range(ceil(log2(max(total, 2))) + 1):
        table = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        moved = hub_lookup(state.filter("up IS NOT NULL"), "up", table, total).filter("_path IS NOT NULL").select(
            "node", F.col("_up").alias("up"), F.concat_ws("/", "_path", "path").alias("path"), (F.col("depth") + F.col("_depth")).alias("depth"))
        state = written(_gathered(state.filter("up IS NULL").unionByName(moved)))
        if state.filter("up IS NOT NULL").isEmpty():
            break
    return state.filter("up IS NULL").select("node.scope", "node.id", "depth", "path")


def observed_links(materials: DataFrame, page_links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Comparison keys seen on each version: literal text links, parsed links, redirect targets."""
    raw = F.regexp_extract_all("content", F.lit(r"https?://[^\s<>\[\]\"']+"), 0)
    both = F.concat(raw, F.transform(raw, lambda u: F.regexp_replace(u, r"[.,;:)]+$", "")))
    literal = materials.select("version_id", F.explode(both).alias("u")).select("version_id", url_key(F.col("u")).alias("link_key"))
    keys = literal.unionByName(page_links.select("version_id", url_key(F.col("url")).alias("link_key"))) \
        .filter("link_key <> ''").distinct()
    moved = aliases.select(url_key(F.col("url")).alias("link_key"), url_key(F.col("final_url")).alias("_to")).filter("_to <> ''")
    return keys.unionByName(keys.join(moved, "link_key").select("version_id", F.col("_to").alias("link_key"))).distinct()


def link_frontier(seeds: DataFrame, links: DataFrame, depth: int, allowance: int = 2) -> DataFrame:
    """Pages followed from each seed: unseen links, source-like ones first, a fixed number per level.

    ``seeds(scope, page_key)``, ``links(page_key, pos, link_key, text)``.
    """
    likely = F.exists(F.array(*[F.lit(w) for w in SOURCE_LIKE]), lambda w: F.contains(
        F.lower(F.concat_ws(" ", "text", "link_key")), w))
    links = cut(links.select("page_key", "pos", "link_key", "text"))
    known = cut(seeds.select("scope", F.col("page_key").alias("key")))
    frontier = seeds.select("scope", "page_key")
    followed = None
    for level in range(1, depth + 1):
        found = frontier.join(links, "page_key").filter(F.col("link_key").cast("string") != "").groupBy("scope", F.col("link_key").alias("key")).agg(
            F.min(F.struct("page_key", "pos")).alias("at"), F.max(likely).alias("likely"))
        new = found.join(known, ["scope", "key"], "left_anti")
        chosen = cut(top_k(new, ["scope"], [F.col("likely").desc(), F.col("at"), F.col("key")], allowance).select(
            "scope", F.lit(level).alias("depth"), F.col("at.page_key").alias("from_key"), "key", "likely"))
        if chosen.isEmpty():
            break
        followed = chosen if followed is None else followed.unionByName(chosen)
        known = cut(known.unionByName(chosen.select("scope", "key")))
        frontier = chosen.select("scope", F.col("key").alias("page_key"))
    return followed if followed is not None else chosen


def version_aliases(materials: DataFrame, fingerprint: Column, seed: Column, scope: list[str]) -> DataFrame:
    """Versions with identical content and metadata under another id; a seed represents its group."""
    keyed = materials.withColumns({"_fp": fingerprint, "_seed": seed})
    lead = keyed.groupBy(*scope, "_fp").agg(
        F.min_by("version_id", F.struct((~F.col("_seed")).alias("a"), F.col("position").alias("b"))).alias("representative"),
        F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return keyed.join(lead.drop("_n"), [*scope, "_fp"]).filter("version_id <> representative").select(
        *scope, "version_id", "representative")


def revisit_cascade(requests: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependency traversal of reanalysis requests; repeated requests go to a cycle log.

    ``requests(from_version, to_version)``; returns (visited, cycle_log).  A version is visited once, at the least number of requests from a
    start, and then asks for all its requests: the one that visits a version is no repeat, all others are.
    """
    requests = cut(requests)
    back = requests.select(F.col("to_version").alias("src"), F.col("from_version").alias("dst"))
    visited = cut(nearest(starts.select("scope", F.col("version_id").alias("node")), back).select("scope", "node", F.col("steps").cast("int").alias("depth")))
    asked = visited.withColumnRenamed("node", "from_version").join(requests, "from_version").groupBy(
        "scope", F.col("to_version").alias("node"), (F.col("depth") + 1).alias("depth")).agg(F.count(F.lit(1)).alias("requests"))
    new = visited.withColumn("_new", F.lit(1))
    log = asked.join(new, ["scope", "node", "depth"], "left").select(
        "scope", "node", "depth", (F.col("requests") - F.coalesce("_new", F.lit(0))).alias("repeats")).filter("repeats > 0")
    return visited, log


def by_locator(tasks: DataFrame, materials: DataFrame) -> DataFrame:
    """Tasks next to the versions whose address or id equals their locator (two equi joins)."""
    wanted = tasks.filter(~is_blank(F.col("locator")))
    by_url = wanted.join(materials.select("pool_id", F.col("url").alias("locator"), "version_id"), ["pool_id", "locator"])
    by_id = wanted.join(materials.select("pool_id", F.col("version_id").alias("locator"), F.col("version_id")), ["pool_id", "locator"])
    return by_url.unionByName(by_id).distinct()


def upstream_arrivals(relations: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Open upstream edges that a new version answers by address or id."""
    waiting = relations.filter("to_version IS NULL AND upstream_locator IS NOT NULL")
    new = arrivals.select(F.col("url").alias("upstream_locator"), F.col("version_id").alias("upstream_version")).unionByName(
        arrivals.select(F.col("version_id").alias("upstream_locator"), F.col("version_id").alias("upstream_version")))
    return waiting.join(new.distinct(), "upstream_locator").filter("from_version <> upstream_version")


def resolve_citations(citations: DataFrame, materials: DataFrame) -> DataFrame:
    """Citation locators to versions: one match is a direct edge, anything else a declared edge
    plus a fetch or search task.
    """
    names = materials.select(F.col("url").alias("locator"), "version_id").unionByName(
        materials.select(F.col("version_id").alias("locator"), F.col("version_id"))).distinct()
    per = names.groupBy("locator").agg(F.count(F.lit(1)).alias("matches"), F.min("version_id").alias("_one"))
    rows = citations.join(per, "locator", "left").fillna(0, ["matches"])
    single = (F.col("matches") == 1) & (F.col("_one") != F.col("from_version"))
    web = F.col("locator").rlike("^https?://[^/?#]+")
    return rows.withColumns({
        "to_version": F.when(single, F.col("_one")), "status": F.when(single, "direct").otherwise("declared"),
        "task_action": F.when(~single, F.when(web, "fetch").otherwise("search"))}).drop("_one")


def chain_codes(chains: DataFrame, edges: DataFrame, documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """Origin chains: start at the input, fetched steps, no non-adjacent repeat, observed steps, end at the origin.

    ``chains(chain_id, input_key, origin_key, steps ARRAY)`` in comparison keys.
    """
    moved = aliases.select(F.col("key").alias("raw"), F.col("to_key"))
    rows = chains.select("chain_id", F.posexplode("steps").alias("pos", "raw")).join(moved, "raw", "left").select(
        "chain_id", "pos", F.coalesce("to_key", "raw").alias("key"))
    fetched = documents.select("key").distinct().withColumn("_doc", F.lit(True))
    known = rows.join(fetched, "key", "left").groupBy("chain_id").agg(
        F.count_if(F.col("_doc").isNull()).alias("unfetched"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda s: s["key"]).alias("keys"))
    # A chain is one row of the input, so its array is bounded by that row.
    squeezed = F.filter(F.col("keys"), lambda k, i: (i == 0) | (k != F.get(F.col("keys"), i - 1)))
    flat = known.withColumn("keys", squeezed)
    steps = flat.select("chain_id", F.posexplode("keys").alias("pos", "a"), "keys").withColumn(
        "b", F.get("keys", F.col("pos") + 1)).filter("b IS NOT NULL").select("chain_id", "a", "b")
    missing = steps.join(edges.select("a", "b").distinct(), ["a", "b"], "left_anti").groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("unlinked"))
    ends = lambda name: F.coalesce(F.col(f"_{name}"), F.col(name))
    base = chains.select("chain_id", "input_key", "origin_key") \
        .join(moved.select(F.col("raw").alias("input_key"), F.col("to_key").alias("_input_key")), "input_key", "left") \
        .join(moved.select(F.col("raw").alias("origin_key"), F.col("to_key").alias("_origin_key")), "origin_key", "left")
    out = base.join(flat, "chain_id", "left").join(missing, "chain_id", "left").fillna(0, ["unfetched", "unlinked"])
    from .admission import reason_codes
    n = F.coalesce(F.size("keys"), F.lit(0))
    first, last = F.get("keys", F.lit(0)), F.get("keys", n - 1)
    return out.select("chain_id", reason_codes(
        (F.col("unfetched") > 0, "unfetched_source"), ((n > 0) & (first != ends("input_key")), "wrong_start"),
        (F.size(F.array_distinct("keys")) != n, "repeated_step"), (F.col("unlinked") > 0, "unobserved_step"),
        ((n == 0) | (last != ends("origin_key")), "wrong_end")).alias("reasons"))
