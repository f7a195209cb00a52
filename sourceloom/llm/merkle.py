"""Merkle manifest of a table: one tree per group, one tree over the groups' roots.

A node is the lower-case hex SHA-256 of its children's hex digests, of ``FAN`` consecutive ones.  A level is not kept as rows but as
text: each aligned block of 4,096 nodes holds its level as one string of 64 characters per node.  Parents are hashes of fixed-width
substrings of that string, and the siblings of a node are the substrings on both sides of it within its run.  A block thus climbs
three levels by itself; what it leaves is one node of the next round, whose blocks hold 4,096 times as many leaves, until every group has
one node.  These roots, ordered by group, go through the same rounds.

Places in a group come from one range shuffle of (group, order, digest) rows: a row's place in its part plus the rows of the
group in earlier parts.  A group of any size is spread over many parts and blocks, and no window or task sees more than one block.
Texts are hashed where they are read and are never shuffled.

Proofs go down the rounds: a block passes to each child the siblings that child has in the block, after its own.  Leaves are folded
with their siblings inside the block's row, so proofs are never rows of their own either.

Defined cases: a null value is ``-``, unlike an empty text; null groups come first, null orders first within a group; rows equal in group
and order are ordered by their digest, and repeated rows are leaves of their own; the root of one group is its subroot;
an empty table has no rows and no root; of further columns only those named are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workdir import stored

FAN, WIDTH = 16, 64
BLOCK = FAN**3  # nodes whose level is one string; it climbs three levels at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*columns: Column) -> Column:
    """Hex SHA-256 of the columns' values with their byte lengths; ``-`` for a null."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def _places(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 among the rows of its ``key`` by ``order``, and their number ``n``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts, "key", *order).sortWithinPartitions("key", *order)
                    .withColumn("at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("part", F.shiftrightunsigned("at", 33))
    counts = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("key", "part", (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                           F.sum("here").over(W.partitionBy("key")).alias("n"))
    return placed.join(starts, ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _parents(level: Column) -> Column:
    """The level above: hashes of the string's runs of ``FAN`` digests."""
    runs = F.sequence(F.lit(0), ((F.octet_length(level) - 1) / (FAN * WIDTH)).cast("int"))
    return F.array_join(F.transform(runs, lambda k: F.sha2(F.substring(level, k * (FAN * WIDTH) + 1, F.lit(FAN * WIDTH)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(key, pos, n, digest, item) nodes to blocks: their items, the strings of three levels and the node left.

    ``climbs`` is the number of levels with several nodes in the whole group, from this round's lowest up: three where the group has
    further blocks.  A string is binary, so that a substring is a slice of bytes.
    """
    grouped = nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).cast("long").alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest", "item"))).alias("rows"))
    n, climbs = F.col("n"), F.col("climbs")
    return grouped.select(
        "key", "block", "n", F.when(n == 1, 0).when(n <= FAN, 1).when(n <= FAN**2, 2).otherwise(3).alias("climbs"),
        F.transform("rows", lambda r: r["item"]).alias("items"),
        F.array_join(F.transform("rows", lambda r: r["digest"]), "").cast("binary").alias("l0")
    ).withColumn("l1", F.when(climbs > 0, _parents(F.col("l0"))).otherwise(F.col("l0"))) \
        .withColumn("l2", F.when(climbs > 1, _parents(F.col("l1"))).otherwise(F.col("l1"))) \
        .withColumn("top", F.when(climbs > 2, _parents(F.col("l2"))).otherwise(F.col("l2")).cast("string"))


def _climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, lowest first, and (key, digest) of the node left per key."""
    rounds = []
    while True:
        rounds.append(stored(_blocks(nodes), f"merkle-{name}"))
        most = rounds[-1].agg(F.max("n").alias("n")).first()["n"]
        if most is None or most <= BLOCK:
            return rounds, rounds[-1].select("key", F.col("top").alias("digest"))
        nodes = rounds[-1].select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"),
                                  F.col("top").alias("digest"), F.lit(None).cast("string").alias("item"))


def _sides(i: Column) -> Column:
    """Siblings left and right of node ``i`` of a block and of its ancestors there, lowest first."""
    def of(level: str, i: Column) -> Column:
        start = i - i % FAN
        return F.struct(F.substring(F.col(level), start * WIDTH + 1, (i - start) * WIDTH).alias("left"),
                        F.substring(F.col(level), (i + 1) * WIDTH + 1, (start + FAN - 1 - i) * WIDTH).alias("right"))
    up = lambda k: (i / k).cast("int")
    return F.slice(F.array(of("l0", i), of("l1", up(FAN)), of("l2", up(FAN**2))), F.lit(1), F.col("climbs"))


def siblings(path: Column) -> Column:
    """All siblings of a path as one string, level by level, left to right."""
    return F.aggregate(path, F.lit("").cast("binary"), lambda a, s: F.concat(a, s["left"], s["right"]))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf.cast("binary"), lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256).cast("binary")).cast("string")


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Lowest blocks with ``path``: the siblings above them, given those above the topmost ones as (key, path, ...)."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        here = blocks.join(above, ["key", "block"])
        nodes = F.transform(F.sequence(F.lit(0), (F.octet_length("l0") / WIDTH).cast("int") - 1), lambda i: F.struct(
            (F.col("block") * BLOCK + i).alias("block"), F.concat(_sides(i), F.col("path")).alias("path")))
        rest = [c for c in above.columns if c not in ("key", "block", "path")]
        above = here.select("key", *rest, F.explode(nodes).alias("node")).select("key", *rest, "node.block", "node.path")
    return rounds[0].join(above, ["key", "block"])


class Manifest(NamedTuple):
    """``groups``: group, subroot; ``leaves``: lowest blocks of all groups with the path above each; ``root``: null for an empty table."""
    groups: DataFrame
    leaves: DataFrame
    root: str | None


def build(rows: DataFrame, group: Column, order: Column, leaf: Column, keep: Column) -> Manifest:
    """The manifest of ``rows``; ``keep`` is a value (of an orderable type) that stays with each leaf."""
    leaves = stored(rows.select(F.coalesce(F.concat(F.lit("."), group.cast("string")), F.lit("")).alias("key"), order.alias("order"),
                                leaf.alias("digest"), keep.alias("item"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    rounds, subroots = _climb(_places(leaves, ["order", "digest", "row"], "merkle-places").select("key", "pos", "n", "digest", "item"), "blocks")
    named = subroots.select(F.lit("").alias("key"), "digest", F.col("key").alias("item"))
    upper, roots = _climb(_places(named, ["item"], "merkle-groups").select("key", "pos", "n", "digest", "item"), "roots")
    root = roots.first()
    start = F.lit(None).cast("array<struct<left:binary,right:binary>>")
    top = _descend(upper, roots.select("key", F.coalesce(start, F.array().cast("array<struct<left:binary,right:binary>>")).alias("path")))
    groups = top.select(F.explode(F.transform("items", lambda key, i: F.struct(
        key.alias("key"), F.substring(F.col("l0"), i * WIDTH + 1, F.lit(WIDTH)).cast("string").alias("subroot"),
        F.concat(_sides(i), F.col("path")).alias("path")))).alias("g")).select("g.*")
    name = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("group")
    return Manifest(groups.select(name, "subroot"), _descend(rounds, groups), root["digest"] if root else None)


def proofs(manifest: Manifest, changed: str | None = None) -> DataFrame:
    """item, leaf, subroot, proof (hash of all siblings), folded (the root from the leaf and its siblings) of every leaf.

    ``changed`` names a field of the items: where it is not null it is folded in place of the leaf.
    """
    def of(item: Column, i: Column) -> Column:
        leaf = F.substring(F.col("l0"), i * WIDTH + 1, F.lit(WIDTH)).cast("string")
        path = F.concat(_sides(i), F.col("path"))
        folded = fold(F.coalesce(item[changed], leaf) if changed else leaf, path)
        return F.struct(item.alias("item"), leaf.alias("leaf"), F.sha2(siblings(path), 256).alias("proof"), folded.alias("folded"))
    return manifest.leaves.select("subroot", F.explode(F.transform("items", of)).alias("l")).select("l.*", "subroot")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def document_proofs(docs: DataFrame, group: str = "source", order: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                    text: str = "text", tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, folded, verified of every row.

    Rows for which ``tampered`` holds are proved with their A-Z lower-cased and the siblings of the table as it is.
    """
    own = [F.col(c) for c in columns]
    other = [lower_ascii(F.col(c)) if c == text else F.col(c) for c in columns]
    bad = F.when(tampered, digest(*other)) if tampered is not None else F.lit(None).cast("string")
    manifest = build(docs, F.col(group), F.col(order), digest(*own), F.struct(F.col(order).alias("id"), bad.alias("bad")))
    root = F.lit(manifest.root).cast("string")
    return proofs(manifest, "bad").select(F.col("item.id").alias(order), "leaf", "subroot", root.alias("root"), "proof", "folded",
                                          (F.col("folded") == root).alias("verified"))
