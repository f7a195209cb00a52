"""Near copies by similarity, found by multi-index hashing of longer SimHash prints.

Texts are alike if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.  Such texts differ in 33 of 256
SimHash bits in the middle and in up to about 52, so exact pigeonholes would need keys of a few bits.  The bits that differ are
nearly always those with the closest votes.  So each text enters, for each of eight 22-bit segments, the small Hamming ball over the
segment's three closest votes: eight keys.  Two texts meet under a key if the bits they differ in are close votes of either.

Under a key, complete 256-bit distances give a forest of links, closest links first (``TIERS``), so no pair list is made.  Keys with more
than ``hot_rows`` texts are cut into blocks and every two blocks meet in a task of their own; no link under the key is lost.  Every link
is then verified on the two shingle sets themselves.  ``README.md`` gives the recall measured against all pairs.

Defined cases: shingles are in lower-cased A-Z words, repeats counted once; fewer words than a shingle are one shingle; texts
without words, null texts included, are alike; texts with one xxhash64 are one text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grouping import connected
from ..operators.skew import hub_lookup, marked
from .simhash import _hashes, keep_first
from .tokens import spans_of
from .workdir import stored

WORDS, SEGMENTS, BITS, FLIPS = 4, 8, 22, 3
TIERS = (16, 28, 36, 44, 52)
SMALL = 32
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The different shingles' hashes, sorted."""
    from xxhash import xxh64_intdigest
    return np.unique(np.array(_hashes(text or "", width, xxh64_intdigest), dtype=np.uint64))


def wide_print(found: np.ndarray) -> tuple[bytes, bytes]:
    """The 256 majority bits as bytes, and each segment's positions of the closest votes."""
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(found), 50_000):
        for word in range(WORDS):
            h = found[at:at + 50_000] ^ np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)
            for k, m in zip((30, 27), _MIX):
                h ^= h >> np.uint64(k)
                h *= np.uint64(m)
            h ^= h >> np.uint64(31)
            counts[64 * word:64 * word + 64] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    margin = 2 * counts - len(found)
    close = np.argsort(np.abs(margin).reshape(SEGMENTS, -1)[:, :BITS], axis=1, kind="stable")[:, :FLIPS]
    return np.packbits(margin > 0, bitorder="little").tobytes(), close.astype(np.uint8).tobytes()


def _prints(width: int):
    def run(series):
        for texts in series:
            texts, rows = texts.tolist(), []
            for a, b in spans_of(["" if t is None else t for t in texts]):
                rows += [wide_print(shingles(t, width)) for t in texts[a:b]]
            yield pd.DataFrame(rows, columns=["print", "close"])
    return run


def _entries(batches):
    """One row per text and key: the segment's number and bits, with every choice of the closest votes flipped."""
    import pyarrow as pa
    choices = (np.arange(1 << FLIPS)[:, None] >> np.arange(FLIPS)) & 1
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        node = batch.column(0).to_numpy(zero_copy_only=False)
        words = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u8").reshape(n, WORDS)
        close = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(n, SEGMENTS, FLIPS)
        segments = (words.view("<u4").astype(np.int64)) & ((1 << BITS) - 1)
        flips = np.einsum("cf,nsf->nsc", choices, np.left_shift(1, close.astype(np.int64)))
        keys = (segments[:, :, None] ^ flips) | (np.arange(SEGMENTS)[None, :, None] << BITS)
        each = SEGMENTS << FLIPS
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(node, each)),
                                          *[pa.array(np.repeat(words[:, w].view(np.int64), each)) for w in range(WORDS)]],
                                         names=["key", "node", *[f"w{w}" for w in range(WORDS)]])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links (visitor, claimed) that connect rows as all pairs within each distance of ``TIERS`` do, closer tiers first.

    What a closer tier has connected is claimed as one, so a cluster costs one comparison with the rest per row, not pairs.
    """
    links, group = [], np.arange(len(prints))
    for reach in TIERS:
        members = {}
        for row, g in enumerate(group.tolist()):
            members.setdefault(g, []).append(row)
        left = np.arange(len(prints))
        while len(left):
            start = group[left[0]]
            queue, left = list(members[start]), left[group[left] != start]
            while queue and len(left):
                here = queue.pop()
                away = _distance(prints[left], prints[here])
                near = np.flatnonzero(away <= reach)
                if not len(near):
                    continue
                near = near[np.argsort(away[near], kind="stable")]
                _, first = np.unique(group[left[near]], return_index=True)
                claimed = left[near[np.sort(first)]]
                links += [(here, int(c)) for c in claimed]
                joined = set(group[claimed].tolist())
                for g in joined:
                    queue += members[g]
                left = left[~np.isin(group[left], list(joined))]
                for g in joined:
                    group[members[g]] = start
        if (group == group[0]).all():
            break
    return links


def _near_groups(start: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers of the groups, of sorted rows that begin at ``start``, that may hold a link: larger ones, and small ones with a near pair."""
    size = np.diff(np.r_[start, len(words)])
    group = np.repeat(np.arange(len(start)), size)
    flagged = size > SMALL
    rest = np.flatnonzero((size[group] > 1) & ~flagged[group])
    g, w = group[rest], words[rest]
    for step in range(1, SMALL):
        same = np.flatnonzero(g[step:] == g[:-step])
        if not len(same):
            break
        for at in range(0, len(same), 200_000):
            part = same[at:at + 200_000]
            flagged[g[part[_distance(w[part], w[part + step]) <= TIERS[-1]]]] = True
    return np.flatnonzero(flagged)


def _links(batches):
    """Links of sorted (key, part, node, words) rows; a group's rows may go on in the next batch."""
    import pyarrow as pa
    held = None

    def links_of(rows: np.ndarray):
        start = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        end = np.r_[start[1:], len(rows)]
        words, found = np.ascontiguousarray(rows[:, 3:]).view(np.uint64), []
        for g in _near_groups(start, words).tolist():
            node, prints = rows[start[g]:end[g], 2], words[start[g]:end[g]]
            order = np.lexsort((node, *prints.T))  # the same pivots under every key
            found += [(node[order[a]], node[order[b]]) for a, b in forest(prints[order])]
        columns = list(zip(*found)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in columns], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)], axis=1)
        if held is not None:
            rows = np.concatenate([held, rows])
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links_of(rows[:cut])
        held = rows[cut:].copy()
    if held is not None:
        yield links_of(held)


def candidates(nodes: DataFrame, hot_rows: int = 4_000) -> DataFrame:
    """Different links (a, b) of ``nodes`` (node, print, close); each b is claimed a bounded number of times, an a may have many."""
    schema = "key long, node long, " + ", ".join(f"w{w} long" for w in range(WORDS))
    entered = nodes.select("node", "print", "close").mapInArrow(_entries, schema)
    hot = stored(entered.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select(
        "key", F.ceil(F.col("n") / (hot_rows / 2)).cast("int").alias("blocks")), "hot-keys")  # at most 64 / hot_rows of all texts
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # block pair (i, j), i <= j, is part i * blocks + j
    part = F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least(block, other).cast("long") * F.col("blocks") + F.greatest(block, other)))
    rows = entered.join(hot, "key", "left").select("key", F.explode(part).alias("part"), "node", *[f"w{w}" for w in range(WORDS)])
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "part").sortWithinPartitions("key", "part").mapInArrow(_links, "a long, b long").distinct()


def verified(links: DataFrame, sets: DataFrame, similarity: float, links_per_row: int = 500) -> DataFrame:
    """The links whose two sets of ``sets`` (node, shingles) are alike; an a with many links is spread by b."""
    total = links.count()
    many = links.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / links_per_row).cast("int").alias("spread")).filter("spread > 1")
    asked = hub_lookup(links, "a", many, total)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    few = asked.filter("spread IS NULL").select("a", "b").join(left, "a")
    salted = asked.filter("spread IS NOT NULL").select("a", "b", F.pmod(F.xxhash64("b"), F.col("spread")).cast("int").alias("salt"))
    # only the sets of an a with many links are repeated; the sets of the others are dealt by node once for both sides
    spread = left.join(many, "a").select("a", "x", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"))
    both = few.unionByName(salted.join(spread, ["a", "salt"]).select("a", "b", "x")).join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document left of each group of texts linked by likeness: the smallest doc_id (null last).

    A document is an id and a text; of rows equal in both, one is left.
    """
    key = {"_id": F.col(doc_id).cast("long"), "_hash": F.xxhash64(F.col(text))}
    rows = docs.select(key["_id"].alias("doc_id"), key["_hash"].alias("hash"), F.col(text).alias("text"))
    run = _prints(width)

    def judge(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(series)

    prints = stored(rows.withColumn("p", F.pandas_udf(judge, "print binary, close binary")(F.col("text"))).select("doc_id", "hash", "p.*"), "wide-prints")
    total = prints.count()
    nodes = stored(prints.groupBy(F.col("hash").alias("node")).agg(F.first("print").alias("print"), F.first("close").alias("close")), "nodes")
    found = stored(candidates(nodes), "candidates")
    asked = found.select(F.explode(F.array("a", "b")).alias("hash")).distinct()

    def hashed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([shingles(t, width).view(np.int64) for t in texts])

    # texts without a link stay where they are; of the others one text per hash is shuffled
    texts = marked(rows, [F.col("hash")], asked, [F.col("hash")]).filter("_maybe").groupBy("hash").agg(F.first("text").alias("text"))
    sets = stored(texts.join(asked, "hash", "left_semi").select(
        F.col("hash").alias("node"), F.pandas_udf(hashed, "array<long>")("text").alias("shingles")), "shingles")
    labels = connected(verified(found, sets, similarity).select(F.col("a").alias("u"), F.col("b").alias("v")))
    copies = prints.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    one = stored(hub_lookup(copies, "hash", labels.withColumnRenamed("node", "hash"), total).withColumn(
        "component", F.coalesce("component", "hash")), "labelled")
    return keep_first(docs, one, key, total)
