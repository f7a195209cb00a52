"""Approximate nearest neighbours with a hash-prefix forest.

Rows are spread over shards by a hash of their id.  A shard builds a forest: every tree has its own random hyperplanes, and
keeps the 64-bit hash strings of the shard's vectors as a sorted array.  A query goes to every shard, as in any index that is
too large for one machine.  There, it descends in each tree to the places with the longest matching prefix; then all
trees ascend together, one bit at a time, and take in the rows that match up to the shorter prefix, until the shard's number of
candidates is reached (the last step is taken whole).  Candidates are compared with the original vectors, and the best of all
shards are the answer.

A shard's size and its share of candidates are fixed, so recall does not fall as the table grows; shards of up to ``least`` rows
are searched whole and exactly.  Each shard is one sorted run of (shard, rows before queries) and queries are streamed past it,
so a task holds one shard and one batch of queries.

Defined cases: vectors that are null, zero, empty or hold a null, NaN or infinite component take no part; neither do those
whose length differs from the most common one; null ids take no part; ties go to the smaller id; repeated rows count as often
as they occur among the neighbours, but a repeated query is asked and ranked once; one id with several different vectors is as
many queries, each with ranks of its own; with fewer candidates than asked for, all that were found are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workdir import stored

BITS = 64


class Forest:
    """Sorted hash strings of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, seed: int):
        self.ids, self.vectors, self.trees = ids, vectors, trees
        self.lengths = np.linalg.norm(vectors, axis=1)
        self.unit = (vectors / self.lengths[:, None]).astype(np.float32)
        self.planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1], BITS)).astype(np.float32)
        self.keys, self.rows = [], []
        for t in range(trees):
            key = self.hash(self.unit, t)
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.rows.append(order.astype(np.int32))

    def hash(self, unit: np.ndarray, tree: int) -> np.ndarray:
        bits = unit @ self.planes[tree] > 0
        return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)[:, 0]

    def candidates(self, units: np.ndarray, wanted: int):
        """Row numbers of the candidates of each query, in turn."""
        n = len(self.ids)
        if wanted >= n:
            for _ in units:
                yield np.arange(n)
            return
        own = [self.hash(units, t) for t in range(self.trees)]
        first, last = [], []  # by depth: [tree, query] range of the rows with the query's prefix of that length
        for depth in range(BITS + 1):
            free = np.uint64((1 << (BITS - depth)) - 1)
            first.append(np.stack([np.searchsorted(keys, h & ~free, side="left") for keys, h in zip(self.keys, own)]))
            last.append(np.stack([np.searchsorted(keys, h | free, side="right") for keys, h in zip(self.keys, own)]))
            if (last[-1] - first[-1]).sum(axis=0).max() < wanted:
                break  # longer prefixes match fewer rows still
        held = np.stack([(b - a).sum(axis=0) for a, b in zip(first, last)])
        for q in range(len(units)):
            depth, found = int(np.flatnonzero(held[:, q] >= wanted).max()), ()
            while True:  # ascend in all trees at once; the same row may match in several
                mark = np.zeros(n, dtype=bool)
                for rows, a, b in zip(self.rows, first[depth][:, q].tolist(), last[depth][:, q].tolist()):
                    mark[rows[a:b]] = True
                found = np.flatnonzero(mark)
                if len(found) >= wanted or not depth:
                    break
                depth -= 1
            yield found

    def nearest(self, query_ids: np.ndarray, versions: np.ndarray, queries: np.ndarray, k: int, wanted: int):
        """query_id, version, id, score of the k best candidates of each query, the query's own id left out."""
        lengths = np.linalg.norm(queries, axis=1)
        units = (queries / lengths[:, None]).astype(np.float32)
        for q, found in enumerate(self.candidates(units, wanted)):
            found = found[self.ids[found] != query_ids[q]]
            if len(found) > 4 * k:  # rough order in single precision; a margin keeps every possible winner
                rough = self.unit[found] @ units[q]
                found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-4]
            score = np.sum(self.vectors[found] * queries[q], axis=1) / (self.lengths[found] * lengths[q])
            best = np.lexsort((self.ids[found], -score))[:k]
            yield from zip([query_ids[q]] * len(best), [versions[q]] * len(best), self.ids[found[best]], score[best])


def _search(trees: int, k: int, wanted: int, seed: int, query_rows: int):
    def run(batches):
        import pyarrow as pa
        shard, parts, forest = None, [], None

        def answer(ids, versions, vectors):
            for at in range(0, len(ids), query_rows):
                rows = list(forest.nearest(ids[at:at + query_rows], versions[at:at + query_rows], vectors[at:at + query_rows], k, wanted))
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([*[pa.array(list(map(int, c)), pa.int64()) for c in columns[:3]],
                                                  pa.array(list(map(float, columns[3])), pa.float64())], names=["query_id", "version", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            shards, asks, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            versions = batch.column(4).to_numpy(zero_copy_only=False)
            vectors = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype="<f8").reshape(batch.num_rows, -1)
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if shards[a] != shard:
                    shard, parts, forest = shards[a], [], None
                if not asks[a]:
                    parts.append((ids[a:b], vectors[a:b].copy()))
                    continue
                if forest is None and parts:
                    forest = Forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), trees, seed)
                    parts = []
                if forest is not None:
                    yield from answer(ids[a:b], versions[a:b], vectors[a:b])
    return run


def _raw(batches):
    """Vectors as little-endian doubles; rows that take no part are left out."""
    import pyarrow as pa
    for batch in batches:
        ids, raw, sizes, asks = [], [], [], []
        for i, v, ask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if i is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, dtype="<f8") + 0.0  # one form of zero, so that equal vectors are equal bytes
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                raw.append(x.tobytes())
                sizes.append(len(x))
                asks.append(bool(ask))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(sizes, pa.int32()), pa.array(asks, pa.bool_())],
                                         names=["id", "vector", "dims", "asks"])


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, trees: int = 48,
           shard_rows: int = 32_768, candidate_share: float = 0.4, least: int = 2_048, seed: int = 11, query_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found, by cosine, of every row that ``is_query`` holds for.

    ``candidate_share`` of a shard's rows, ``least`` at least, is the number of candidates per shard: the trade of work for recall.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    usable = stored(rows.mapInArrow(_raw, "id long, vector binary, dims int, asks boolean"), "vectors")
    sizes = usable.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(1).first()
    if sizes is None:
        return usable.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable, shards = usable.filter(F.col("dims") == sizes["dims"]), -(-sizes["n"] // shard_rows)
    entries = usable.select(F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("ask"), "id", "vector", F.lit(0).cast("long").alias("version"))
    different = usable.filter("asks").select("id", "vector").distinct()
    asked = different.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("ask"), "id", "vector",
                             F.xxhash64("vector").alias("version"))
    runs = entries.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "ask")
    wanted = int(candidate_share * -(-sizes["n"] // shards))
    found = runs.mapInArrow(_search(trees, k, max(wanted, least), seed, query_rows), "query_id long, version long, vec_id long, score double")
    best = W.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
