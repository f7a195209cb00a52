"""SimHash near copies by multi-index hashing.

A fingerprint is the majority vote of the 64-bit hashes of a text's word shingles.  Two fingerprints within three bits agree
in one of their two 32-bit halves up to one bit.  So each different fingerprint is entered under both halves, and under each
half with one clear bit set: of two halves that differ in one bit, exactly one reaches the other's key that way.  Fingerprints
under one key are compared in full.

No pair list is made: inside a key, a search from fingerprint to fingerprint returns a spanning forest of the links, at most
one link per fingerprint.  Keys with more than ``hot_rows`` fingerprints are split further by each byte of the other half,
one of which must agree; this loses no link.  Copies with one fingerprint are one node.

Defined cases: a null text or one without words has fingerprint 0, which is linked like any other; fewer words than a shingle
are one shingle; null doc_ids belong to components but do not name them; repeated rows each get a row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grouping import connected
from ..operators.skew import hub_lookup, marked
from .tokens import spans_of
from .workdir import stored

NEAR = 3


def _hashes(text: str, width: int, digest) -> list[int]:
    words = text.encode().lower().split()  # ASCII case and white space only
    if len(words) < width:
        return [digest(b" ".join(words), 42)] if words else []
    return [digest(b" ".join(s), 42) for s in zip(*[words[k:] for k in range(width)])]


def vote(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 100_000):
        block = hashes[at:at + 100_000].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def _fingerprints(width: int):
    def run(series):
        from xxhash import xxh64_intdigest
        for texts in series:
            texts = ["" if t is None else t for t in texts.tolist()]
            found = []
            for a, b in spans_of(texts):
                found += [vote(np.array(_hashes(t, width, xxh64_intdigest), dtype="<u8")) for t in texts[a:b]]
            yield pd.Series(np.array(found, dtype=np.uint64).view(np.int64))
    return run


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, output: str = "fingerprint") -> DataFrame:
    """``docs`` with the 64-bit fingerprint of every whole text as a signed long; only the text goes to Python."""
    run = _fingerprints(width)

    def judge(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(series)

    return docs.withColumn(output, F.pandas_udf(judge, "long")(F.col(text)))


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints: each is visited once and claims its unvisited neighbours."""
    links, left = [], prints
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            here = queue.pop()
            near = np.bitwise_count(left ^ here) <= NEAR
            if near.any():
                found = left[near]
                links += [(here, x) for x in found]
                queue += list(found)
                left = left[~near]
    return links


def _links(batches):
    """Links of sorted (key, part, fingerprint) rows; a key's rows may go on in the next batch."""
    import pyarrow as pa
    names, held = ["a", "b"], None

    def links_of(key: np.ndarray, prints: np.ndarray):
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(key)]
        out, pairs = [], ends - starts == 2
        a, b = prints[starts[pairs]], prints[starts[pairs] + 1]
        near = np.bitwise_count(a ^ b) <= NEAR
        out = list(zip(a[near], b[near]))
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            out += _forest(prints[s:e])
        return pa.RecordBatch.from_arrays([pa.array(np.array([x[k] for x in out], dtype=np.uint64).view(np.int64)) for k in (0, 1)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)], axis=1)
        prints = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        if held is not None:
            key, prints = np.concatenate([held[0], key]), np.concatenate([held[1], prints])
        last = np.flatnonzero((key != key[-1]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links_of(key[:cut], prints[:cut])
        held = key[cut:].copy(), prints[cut:].copy()
    if held is not None:
        yield links_of(*held)


def links(prints: DataFrame, hot_rows: int = 20_000) -> DataFrame:
    """Links (a, b) that connect the different fingerprints ``fingerprint`` as all pairs within three bits would."""
    low = (1 << 32) - 1
    fp = F.col("fingerprint")
    halves = prints.select(fp, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.shiftrightunsigned(fp, 32).alias("half"), fp.bitwiseAND(low).alias("other")),
        F.struct(F.lit(1).alias("side"), fp.bitwiseAND(low).alias("half"), F.shiftrightunsigned(fp, 32).alias("other")))).alias("h"))

    def keys(side, half):
        """The half itself and its neighbours with one clear bit set, marked by the side."""
        clear = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda j: half.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), j)) == 0)
        neighbours = F.transform(clear, lambda j: half.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)))
        return F.transform(F.concat(F.array(half), neighbours), lambda key: key.bitwiseOR(F.shiftleft(side.cast("long"), 40)))

    entered = halves.select("fingerprint", F.col("h.other").alias("other"), F.explode(keys(F.col("h.side"), F.col("h.half"))).alias("key"))
    # counted per half, then entered as the fingerprints are: at most 66 / hot_rows of all fingerprints are hot; written, so that
    # the join below knows how few they are and spares a shuffle
    sizes = halves.groupBy("h.side", "h.half").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(sizes.select("n", F.explode(keys(F.col("side"), F.col("half"))).alias("key")).groupBy("key").agg(F.sum("n").alias("n"))
                 .filter(F.col("n") > hot_rows).select("key", F.lit(True).alias("hot")), "hot-keys")
    part = F.when(F.col("hot"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: (
        j * 256 + F.call_function("shiftright", F.col("other"), j * 8).bitwiseAND(255)).cast("int"))).otherwise(F.array(F.lit(-1)))
    split = entered.join(hot, "key", "left").select("key", F.explode(part).alias("part"), "fingerprint")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = split.repartition(n, "key", "part").sortWithinPartitions("key", "part")
    return grouped.mapInArrow(_links, "a long, b long")


def _labelled(prints: DataFrame, n: int) -> DataFrame:
    """fingerprint, component (smallest fingerprint linked), component_id (smallest doc_id linked) of ``n`` (doc_id, fingerprint) rows."""
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest"))
    found = connected(links(nodes.select("fingerprint")).select(F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "smallest", F.coalesce("component", "fingerprint").alias("component"))
    names = labelled.groupBy("component").agg(F.min("smallest").alias("component_id"))
    return hub_lookup(labelled, "component", names, n).select("fingerprint", "component", "component_id")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint, component (smallest fingerprint linked), component_id (smallest doc_id linked), one row per row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = stored(fingerprints(rows, "text", width).drop("text"), "fingerprints")
    n = prints.count()
    return hub_lookup(prints, "fingerprint", _labelled(prints, n), n).select("doc_id", "fingerprint", "component", "component_id")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The rows of ``docs`` with one document left of each component: the smallest doc_id (null last), then the smallest text hash.

    A document is an id and a text; of rows equal in both, one is left.  Everything is decided on ids and hashes.  The texts are
    read once more to drop what is not left, usually little: only texts that may be on the written list are shuffled.  Empty tables stay empty.
    """
    key = {"_id": F.col(doc_id).cast("long"), "_hash": F.xxhash64(F.col(text))}
    rows = docs.select(key["_id"].alias("doc_id"), key["_hash"].alias("hash"), F.col(text).alias("text"))
    prints = stored(fingerprints(rows, "text", width).drop("text"), "fingerprints")
    total = prints.count()
    copies = prints.groupBy("doc_id", "hash", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    one = stored(hub_lookup(copies, "fingerprint", _labelled(prints, total), total), "labelled")
    return keep_first(docs, one, key, total)


def keep_first(docs: DataFrame, one: DataFrame, key: dict, total: int) -> DataFrame:
    """The rows of ``docs`` that ``one`` (doc_id, hash, component, n rows alike) leaves: the first document of each component, once."""
    rank = F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "hash")
    kept = one.groupBy("component").agg(F.min(rank).alias("k")).select("component", F.col("k").alias("first"))
    # what goes, and what is left of several equal rows
    judged = stored(hub_lookup(one, "component", kept, total).select(
        F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.when(rank == F.col("first"), F.lit(True)).otherwise(False).alias("_left"), "n")
        .filter("n > 1 OR NOT _left").drop("n"), "judged")
    keyed = docs.withColumns(key)
    same = lambda other: keyed["_id"].eqNullSafe(other["_id"]) & (keyed["_hash"] == other["_hash"])
    several = judged.filter("_left")
    # texts that no listed document can have stay where they are; only the others meet the list
    sifted = marked(keyed, [F.col("_id"), F.col("_hash")], judged, [F.col("_id"), F.col("_hash")])
    keyed = sifted.filter("_maybe").drop("_maybe")
    left = sifted.filter("NOT _maybe").drop("_maybe").unionByName(keyed.join(judged, same(judged), "left_anti"))
    return left.unionByName(keyed.join(several, same(several), "left_semi").dropDuplicates(list(key))).drop(*key)
