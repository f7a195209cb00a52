"""Task retrieval: lexical overlap, exact locators, greedy cover, attribution, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank, search_terms
from ..session import cut, written
from .admission import reason_codes
from .lineage import by_locator
from .skew import top_k


def action_rank(action: Column) -> Column:
    """Fetch before reanalyse before search."""
    return F.when(action == "fetch", 0).when(action == "reanalyse", 1).otherwise(2)


def task_order() -> list[Column]:
    return [action_rank(F.col("action")), F.col("action"), F.coalesce("locator", F.lit("")), F.col("question"), F.col("task_id")]


def lexical_scores(tasks: DataFrame, documents: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Distinct shared terms per (task, version), positive scores only.

    ``tasks(task_id, query)``, ``documents(version_id, text)``.  The text is
    reduced to terms and joined to the tasks' terms; hot terms are split at run
    time, and counts are summed per task before they are shuffled.
    """
    scope = scope or []
    asked = tasks.select(*scope, "task_id", F.explode(search_terms(F.col("query"))).alias("term"))
    terms = documents.select(*scope, "version_id", search_terms(F.col("text")).alias("terms"))
    posted = terms.select(*scope, "version_id", F.explode("terms").alias("term"))
    pairs = posted.join(asked, [*scope, "term"])
    return pairs.groupBy("version_id", "task_id", *scope).agg(F.count(F.lit(1)).alias("score"))


def ranked_terms(tasks: DataFrame, documents: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each task's terms in an array, rarest first, and a written table of each version's asked terms.

    Terms that no document has are left out.  The arrays are as long as a query or a text, whatever the number of rows.
    """
    asked = tasks.select(*scope, "task_id", F.explode(search_terms(F.col("query"))).alias("term")).distinct()
    terms = documents.select(*scope, "version_id", search_terms(F.col("text")).alias("terms"))
    posted = terms.select(*scope, "version_id", F.explode("terms").alias("term")).join(
        asked.select(*scope, "term").distinct(), [*scope, "term"], "left_semi")
    held = written(posted.groupBy(*scope, "version_id").agg(F.collect_list("term").alias("held")))
    frequency = held.select(*scope, F.explode("held").alias("term")).groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("_n"))
    ranked = asked.join(frequency, [*scope, "term"]).groupBy(*scope, "task_id").agg(
        F.sort_array(F.collect_list(F.struct("_n", "term")))["term"].alias("terms"))
    return ranked, held


def _shared(tasks: DataFrame, held: DataFrame, terms: Column, scope: list[str]) -> DataFrame:
    """(task, version) pairs that share one of ``terms``, with the number shared."""
    asked = tasks.select(*scope, "task_id", F.explode(terms).alias("term"))
    posted = held.select(*scope, "version_id", F.explode("held").alias("term"))
    return posted.join(asked, [*scope, "term"]).groupBy(*scope, "task_id", "version_id").agg(F.count(F.lit(1)).alias("part"))


def _completed(pairs: DataFrame, tasks: DataFrame, held: DataFrame, read: Column, scope: list[str]) -> DataFrame:
    """Whole scores of pairs whose first ``read`` terms are counted in ``part``: the others are looked up for these versions only."""
    rest = tasks.select(*scope, "task_id", F.slice("terms", read + 1, F.size("terms")).alias("_rest"))
    rows = pairs.select(*scope, "task_id", "version_id", "part").join(rest, [*scope, "task_id"]).join(held, [*scope, "version_id"])
    return rows.select("version_id", "task_id", *scope, (F.col("part") + F.size(F.array_intersect("_rest", "held"))).alias("score"))


def lexical_survivors(tasks: DataFrame, documents: DataFrame, k: int, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs that can still be among the best ``k`` of their task; the tasks and versions that complete their scores.

    The rarer half of a task's m terms gives first counts.  The whole scores of the 4 k best of these set a floor: the k-th of them.
    A version at or over the floor shares at least one of the m - floor + 1 rarest terms, so only these are ever joined, and a
    pair stays if its count and all unread terms together reach the floor.  Nothing is dropped that could tie.
    """
    scope = scope or []
    key, c = [*scope, "task_id"], F.col
    ranked, held = ranked_terms(tasks, documents, scope)
    ranked = written(ranked.withColumn("half", F.ceil(F.size("terms") / 2).cast("int")))
    first = written(_shared(ranked, held, F.slice("terms", F.lit(1), c("half")), scope))
    best = top_k(first, key, [c("part").desc(), c("version_id")], 4 * k)
    floors = top_k(_completed(best, ranked, held, c("half"), scope), key, [c("score").desc()], k).groupBy(*key).agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
    bounded = written(ranked.join(floors, key, "left").withColumn("floor", F.coalesce("floor", F.lit(1)).cast("int")).withColumn(
        "read", F.greatest(F.size("terms") - c("floor") + 1, c("half"))))
    more = _shared(bounded.filter("read > half"), held, F.slice("terms", c("half") + 1, c("read") - c("half")), scope)
    # a pair is a few bytes but costs an array lookup, so partitions must not be merged by their size in bytes
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = first.unionByName(more).repartition(parts, *key, "version_id").groupBy(*key, "version_id").agg(F.sum("part").alias("part"))
    least = bounded.select(*key, (c("floor") + c("read") - F.size("terms")).alias("_least"))
    return counts.join(least, key).filter("part >= _least").drop("_least"), bounded, held


def lexical_topk(tasks: DataFrame, documents: DataFrame, k: int, scope: list[str] | None = None) -> DataFrame:
    """Best ``k`` versions per task by distinct shared terms; ties go to the smaller version id.

    Exact: hot terms are looked up only for pairs that the rare terms leave in question.  Repeated task rows count once; version ids
    are unique; null queries and texts have no terms.
    """
    pairs, asked, held = lexical_survivors(tasks, documents, k, scope)
    scores = _completed(pairs, asked, held, F.col("read"), scope or [])
    return top_k(scores, [*(scope or []), "task_id"], [F.col("score").desc(), F.col("version_id")], k)


def unseen(candidates: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(returned.select(*keys).distinct(), keys, "left_anti")


def candidates(tasks: DataFrame, materials: DataFrame, returned: DataFrame) -> DataFrame:
    """Candidate versions of every task in its pool.

    Fetch matches unseen versions by address or id, reanalyse matches returned
    versions by id, search matches unseen versions by shared terms.
    """
    key = ["pool_id", "version_id"]
    fetch = unseen(by_locator(tasks.filter("action = 'fetch'"), materials).select("pool_id", "task_id", "version_id"), returned, key)
    again = tasks.filter("action = 'reanalyse'").select("pool_id", "task_id", F.col("locator").alias("version_id")) \
        .join(returned.select(*key).distinct(), key, "left_semi").select("pool_id", "task_id", "version_id")
    wanted = tasks.filter("action = 'search'").select("pool_id", "task_id", F.coalesce("locator", "question").alias("query"))
    pool = unseen(materials, returned, key).select("pool_id", "version_id", F.concat_ws(" ", "url", "content").alias("text"))
    found = lexical_scores(wanted, pool, ["pool_id"]).select("pool_id", "task_id", "version_id")
    return fetch.unionByName(again).unionByName(found)


def greedy_cover(tasks: DataFrame, options: DataFrame, capacity: int) -> DataFrame:
    """Choose at most ``capacity`` versions per pool so that tasks are covered early.

    One pass serves every pool at once, by windows inside a pool: the most
    constrained pending task is picked, then its option that covers most pending
    tasks.  Exact
    tasks (fetch, reanalyse) are covered before searches, and leftover capacity
    is filled in task order.  Returns (pool_id, version_id, pick).
    """
    # a number for the order: questions may be whole texts, and a task's order stands in each of its pairs
    ranked = tasks.withColumn("_rank", F.dense_rank().over(W.partitionBy("pool_id").orderBy(*task_order()))) \
        .withColumn("_exact", (F.col("action") != "search").cast("int"))
    pool, of_task, of_version = (W.partitionBy("pool_id", *more) for more in ([], ["task_id"], ["version_id"]))
    pairs = options.distinct().join(ranked.select("pool_id", "task_id", "_rank", "_exact"), ["pool_id", "task_id"])
    # one partitioning by pool serves every pass: the state of tasks, versions and pools travels in the rows
    state = cut(pairs.repartition("pool_id").select(
        "pool_id", "task_id", "version_id", "_rank", "_exact", F.count(F.lit(1)).over(of_task).alias("_size"),
        F.lit(False).alias("_covered"), F.lit(0).alias("_picks"), F.lit(None).cast("int").alias("pick")))
    c = F.col
    for _ in range(capacity):
        free = ~c("_covered") & c("pick").isNull() & (c("_picks") < capacity)
        step = state.withColumn("_phase", F.max(F.when(free, c("_exact"))).over(pool)) \
            .withColumn("_active", F.coalesce(free & (c("_exact") == c("_phase")), F.lit(False))) \
            .withColumn("_task", F.min(F.when(c("_active"), F.struct("_size", "_rank", "task_id"))).over(pool)) \
            .withColumn("_covers", F.count(F.when(~c("_covered") & (c("_exact") == c("_phase")), 1)).over(of_version)) \
            .withColumn("_best", F.min(F.when(c("_active") & (c("task_id") == c("_task")["task_id"]),
                                              F.struct((-c("_covers")).alias("n"), c("version_id").alias("v")))).over(pool)["v"]) \
            .withColumn("_hit", F.coalesce(c("version_id") == c("_best"), F.lit(False))) \
            .withColumn("pick", F.when(c("_hit"), c("_picks") + 1).otherwise(c("pick"))) \
            .withColumn("_covered", c("_covered") | F.max("_hit").over(of_task)) \
            .withColumn("_picks", c("_picks") + c("_best").isNotNull().cast("int"))
        open_pools = Observation()
        state = cut(step.observe(open_pools, F.count_if(c("_hit")).alias("n")).select(*state.columns))
        if not open_pools.get["n"]:
            break
    chosen = state.filter("pick IS NOT NULL").select("pool_id", "version_id", "pick").distinct()
    return fill_capacity(state, chosen, capacity)


def fill_capacity(pairs: DataFrame, chosen: DataFrame, capacity: int) -> DataFrame:
    """Give leftover capacity to remaining options in task order, then version order."""
    left = pairs.groupBy("pool_id", "version_id").agg(F.min("_rank").alias("_rank"))
    used = chosen.groupBy("pool_id").agg(F.max("pick").alias("_used"))
    spare = left.join(chosen.select("pool_id", "version_id"), ["pool_id", "version_id"], "left_anti")
    spare = top_k(spare, ["pool_id"], [F.col("_rank"), F.col("version_id")], capacity, "_n").join(used, "pool_id", "left")
    extra = spare.withColumn("pick", (F.coalesce("_used", F.lit(0)) + F.col("_n")).cast("int")).filter(F.col("pick") <= capacity)
    return chosen.unionByName(extra.select("pool_id", "version_id", "pick"))


def attribution(chosen: DataFrame, options: DataFrame) -> DataFrame:
    """Which tasks each returned version answers."""
    rows = options.join(chosen.select("pool_id", "version_id"), ["pool_id", "version_id"], "left_semi")
    return rows.select("pool_id", "version_id", "task_id").distinct()


def task_feedback(tasks: DataFrame, options: DataFrame, chosen: DataFrame) -> DataFrame:
    """Returned, budget_exhausted or unavailable per task, with the number of returns."""
    marked = options.select("pool_id", "task_id", "version_id").distinct().join(
        chosen.select("pool_id", "version_id", F.lit(1).alias("_got")), ["pool_id", "version_id"], "left")
    per = marked.groupBy("pool_id", "task_id").agg(F.count("_got").alias("returned"), F.count(F.lit(1)).alias("_all"))
    out = tasks.select("pool_id", "task_id").join(per, ["pool_id", "task_id"], "left").fillna(0, ["returned", "_all"])
    status = F.when(F.col("returned") > 0, "returned").when(F.col("_all") > 0, "budget_exhausted").otherwise("unavailable")
    return out.select("pool_id", "task_id", "returned", status.alias("status"))


def feedback_codes(feedback: DataFrame, issued: DataFrame, returns: DataFrame) -> DataFrame:
    """Contract of provider feedback: known task, unchanged definition, status agrees with attributed returns."""
    key = ["round", "task_id"]
    got = returns.groupBy(*key).agg(F.count_distinct("version_id").alias("_got"),
                                    F.bit_xor(F.xxhash64("version_id")).alias("_sum"))
    named = feedback.select(*key, F.explode("version_ids").alias("version_id")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("_named"), F.count_distinct("version_id").alias("_distinct"),
        F.bit_xor(F.xxhash64("version_id")).alias("_named_sum"))
    rows = feedback.join(issued.select(*key, F.col("action").alias("_action"), F.col("locator").alias("_locator")), key, "left") \
        .join(got, key, "left").join(named, key, "left").fillna(0, ["_got", "_named", "_distinct"])
    c = F.col
    differs = (c("_got") != c("_named")) | ~c("_sum").eqNullSafe(c("_named_sum"))
    return rows.select(*key, reason_codes(
        (c("_action").isNull(), "unissued_task"),
        (c("_action").isNotNull() & ((c("action") != c("_action")) | ~c("locator").eqNullSafe(c("_locator"))), "changed_task"),
        (~c("status").isin("returned", "unavailable", "budget_exhausted"), "invalid_status"),
        (c("_named") != c("_distinct"), "duplicate_version_ids"),
        ((c("status") == "returned") & ((c("_got") == 0) | differs), "returned_mismatch"),
        ((c("status") != "returned") & ((c("_got") > 0) | (c("_named") > 0)), "non_returned_conflict")).alias("reasons"))


def catalog(materials: DataFrame, returned: DataFrame, cutoff: Column, chars: int = 800) -> DataFrame:
    """Preview rows of unseen versions available at the cutoff."""
    rows = unseen(materials, returned, ["pool_id", "version_id"]).filter(F.col("available_at") <= cutoff)
    return rows.select("pool_id", "version_id", "url", "issuer", F.left("content", F.lit(chars)).alias("preview"))


def bounded_distinct(rows: DataFrame, key: str, value: str, order: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """First ``limit`` distinct values per key by first appearance, and a truncation flag per key."""
    first = rows.groupBy(key, value).agg(F.min(order).alias(order))
    kept = top_k(first, [key], [F.col(order)], limit)
    flags = first.groupBy(key).agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return kept, flags


def split_capped(rows: DataFrame, key: str, value: str, order: str, limit: int) -> DataFrame:
    """Distinct non-blank values per key by first appearance, ``kept`` up to ``limit`` and listed as omitted beyond it.

    The first ``limit`` are found by a top-k that is cut before the shuffle, the others are the rest: no window holds all values of
    a key.  Equal positions are ordered by value; a null key or value is left out.
    """
    first = rows.filter(F.col(key).isNotNull() & ~is_blank(F.col(value))).groupBy(key, value).agg(F.min(order).alias(order))
    kept = top_k(first, [key], [F.col(order), F.col(value)], limit).select(key, value, F.lit(True).alias("kept"))
    return first.join(kept, [key, value], "left").fillna(False, ["kept"])


def kept_and_omitted(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Counts of kept and omitted rows per key under the cap."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.select(key, F.least(F.col("n"), F.lit(limit)).cast("long").alias("kept"), F.greatest(F.col("n") - limit, F.lit(0)).cast("long").alias("omitted"))
