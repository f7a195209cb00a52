"""Independent source groups: transitive copies are one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_hash, fold, norm_ws
from ..functions.urls import canonical_url
from ..session import cut_counted
from .skew import HUB_ROWS, hub_lookup


def evidence_keys() -> dict[str, Column]:
    """The four provenance keys of an evidence row, in comparable form."""
    c = F.col
    return {"publisher": fold(norm_ws(c("publisher_group"))), "origin": fold(norm_ws(c("origin_id"))),
            "url": canonical_url(c("url")), "content": content_hash(fold(norm_ws(c("content"))))}


def _smallest(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(value).alias(name))


def connected(edges: DataFrame, hub_rows: int = HUB_ROWS) -> DataFrame:
    """Smallest reachable node per node, from undirected ``edges(u, v)``.

    Alternates large-star and small-star contraction, which needs a logarithmic
    number of passes however long the chains are.  An edge is kept once, from its larger
    node u to its smaller node v, so a node's smallest neighbour is a partial
    aggregate over u.  Each pass is checkpointed, so an executor loss replays one
    pass; count and checksum come with the write.
    """
    current, state = cut_counted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "u", "v")
    while state[0] > 0:
        # every larger neighbour of v moves to v's smallest neighbour
        large = hub_lookup(current, "v", _smallest(current, "u", "v", "m").withColumnRenamed("u", "v"), state[0], hub_rows).select(
            "u", F.coalesce("m", "v").alias("v"))
        # u and its smaller neighbours move to the smallest of them
        least = _smallest(large, "u", "v", "m")
        small = hub_lookup(large, "u", least, state[0], hub_rows).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        current, following = cut_counted(small, "u", "v")
        if following == state:
            break
        state = following
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


def source_groups(rows: DataFrame, scope: list[str], keys: dict[str, Column], id_col: str = "id",
                  carry: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Components of rows that share any key inside the scope.

    Returns (signatures, labels).  Rows with all keys equal are folded first, so
    mass copies cost one partial aggregate; ``carry`` aggregates travel with the
    signature and no row-level text enters the graph.
    """
    names = [f"key_{k}" for k in keys]
    keyed = rows.withColumns({f"key_{k}": c for k, c in keys.items()})
    signatures = keyed.groupBy(*scope, *names).agg(F.min(id_col).alias("node"), *(carry or []))
    # A node name must be unique across scopes.
    named, (n, _) = cut_counted(signatures.withColumn("node", F.md5(F.to_json(F.struct(*scope, *names, "node")))), "node")
    tokens = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.md5(F.to_json(F.struct(
        *scope, F.lit(k).alias("kind"), F.col(k).alias("value"))))) for k in names]))
    links = named.select("node", F.explode(tokens).alias("k"))
    edges = hub_lookup(links, "k", _smallest(links, "k", "node", "lead"), n * len(names)).select(
        F.col("node").alias("u"), F.col("lead").alias("v")).filter("u <> v")
    labels = connected(edges)
    out = named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return out, labels


def stance_flags() -> list[Column]:
    """Aggregates a signature carries: which stances occur and how many rows it folds."""
    return [F.bool_or(F.col("stance") == s).alias(f"has_{s}") for s in ("supports", "contradicts", "neutral")] + [
        F.count(F.lit(1)).alias("rows")]


def group_summary(signatures: DataFrame, scope: list[str]) -> DataFrame:
    """One row per component: stances present, conflict flag, folded rows."""
    flags = ("has_supports", "has_contradicts", "has_neutral")
    out = signatures.groupBy(*scope, "component").agg(
        *[F.bool_or(f).alias(f) for f in flags], F.sum("rows").alias("rows"))
    return out.withColumn("conflicting", F.col("has_supports") & F.col("has_contradicts"))


def decide(supports: Column, contradicts: Column, min_independent: int = 2) -> Column:
    return (F.when((supports > 0) & (contradicts > 0), "conflicting")
            .when(supports >= min_independent, "supported")
            .when(contradicts >= min_independent, "contradicted").otherwise("unresolved"))


def decision_by_sources(groups: DataFrame, scope: list[str], min_independent: int = 2) -> DataFrame:
    """Independent counts and the decision per scope; a mixed group counts on both sides."""
    out = groups.groupBy(*scope).agg(
        F.count_if("has_supports").alias("supports"), F.count_if("has_contradicts").alias("contradicts"),
        F.count_if("has_neutral").alias("neutral"), F.count(F.lit(1)).alias("total"),
        F.count_if("conflicting").alias("conflicting"))
    return out.withColumn("decision", decide(F.col("supports"), F.col("contradicts"), min_independent))


def independent_decision(evidence: DataFrame, scope: list[str], keys: dict[str, Column] | None = None,
                         min_independent: int = 2) -> DataFrame:
    """Admitted evidence to one decision per scope."""
    signatures, _ = source_groups(evidence, scope, keys or evidence_keys(), carry=stance_flags())
    return decision_by_sources(group_summary(signatures, scope), scope, min_independent)


def decision_per_round(evidence: DataFrame, claim: str, round_col: str, max_rounds: int,
                       keys: dict[str, Column] | None = None, min_independent: int = 2) -> DataFrame:
    """Decision over the evidence so far, for each round.

    A late bridge can merge earlier groups, so each round needs its own
    components.  A row is copied to the rounds it is visible in (a small fixed
    number) and all rounds are grouped in one job.
    """
    spread = evidence.filter(F.col(round_col) <= max_rounds).withColumn(
        "upto_round", F.explode(F.sequence(F.col(round_col).cast("int"), F.lit(max_rounds))))
    return independent_decision(spread, [claim, "upto_round"], keys, min_independent)
