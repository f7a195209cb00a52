"""Token ids in files: frequency-ranked ids, variable-length bytes, control bytes apart.

A file set is a folder of Parquet files that hold binary segments, and an index.  Documents are in ascending doc_id order
over the whole set.  A segment holds consecutive documents of one part with up to ``segment_tokens`` tokens (a longer
document has a segment to itself):

* ``ranking``: the ids that occur in it, most frequent first (little-endian unsigned 32-bit), so frequent ids have small ranks
* ``control``: two bits per token, the number of bytes of its rank less one, four tokens to a byte, lowest bits first
* ``data``: the ranks without leading zero bytes, little-endian, one after the other
* ``doc_ids``, ``lengths``: of its documents, as signed 64-bit integers

Segments are decoded by tables: a control byte gives its four sizes, and sizes give the places of all ranks at once.

Defined cases: null text has only the end id; null doc_ids come first and are read back as null; repeated rows are kept,
rows with equal doc_id in the order of their text hash; an empty table gives an empty file set.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tokens import LibraryEncoder, default_path, per_worker
from .workdir import new_path

NO_ID = -(1 << 63)  # stands for a null doc_id
SEGMENT = ("part int, segment int, n_docs long, n_tokens long, ranking binary, control binary, data binary, "
           "doc_ids binary, lengths binary")


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """ranking, control and data of some ids."""
    values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))
    rank_of = np.empty(len(values), dtype=np.uint32)
    rank_of[order] = np.arange(len(values), dtype=np.uint32)
    ranks = rank_of[inverse]
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    codes[: len(ids)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    return values[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1  # sizes of the four tokens of each control byte


def unpack(n: int, ranking: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The ids of a segment."""
    if not n:
        return np.zeros(0, dtype="<u4")
    size = SIZES[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    begin = np.cumsum(size) - size
    raw = np.r_[np.frombuffer(data, dtype=np.uint8), np.zeros(3, dtype=np.uint8)]
    ranks = raw[begin].astype(np.uint32)
    for k in (1, 2, 3):
        longer = size > k
        ranks[longer] |= raw[begin[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranking, dtype="<u4")[ranks]


def _segments(shared, end_id: int, segment_tokens: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        encoder, part = shared.value(), TaskContext.get().partitionId()
        tail = np.array([end_id], dtype="<u4").tobytes()
        held, ids, size, number = [], [], 0, 0

        def flush():
            packed = pack(np.frombuffer(b"".join(held), dtype="<u4"))
            lengths = np.array([len(h) // 4 for h in held], dtype="<i8")
            row = [part, number, len(held), size, *packed, np.array(ids, dtype="<i8").tobytes(), lengths.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            names = [c.split()[0] for c in SEGMENT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                encoded = encoder.encode(text.as_py()) + tail
                if held and size + len(encoded) // 4 > segment_tokens:
                    yield flush()
                    held, ids, size, number = [], [], 0, number + 1
                held.append(encoded)
                ids.append(NO_ID if doc_id is None else doc_id)
                size += len(encoded) // 4
        if held:
            yield flush()
    return run


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
          end_id: int = 1, segment_tokens: int = 4_000_000, keep: int = 400_000) -> None:
    """Encode every whole text, append ``end_id`` and write segments and their index below ``folder``.

    Texts are range-partitioned once, before encoding: the sampling of the ranges then reads ids and texts but encodes nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    shared = per_worker(docs, LibraryEncoder, path or default_path("word_bpe_49k.json"), keep)
    placed.mapInArrow(_segments(shared, end_id, segment_tokens), SEGMENT) \
        .write.parquet(f"{folder}/segments")
    # index: part totals first, so that no window spans all segments
    sizes = spark.read.schema(SEGMENT).parquet(f"{folder}/segments").select("part", "segment", "n_tokens")
    per_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    sizes.join(bases, "part").select(
        "part", "segment", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start")) \
        .coalesce(1).write.parquet(f"{folder}/index")


def _documents(batches):
    import pyarrow as pa
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["n_tokens"], row["ranking"], row["control"], row["data"]).astype("<u4")
            doc_ids, lengths = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
            ends = np.cumsum(lengths)
            for at in range(0, len(ends), 2_000):
                some = slice(at, at + 2_000)
                starts = ends[some] - lengths[some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids[some], mask=doc_ids[some] == NO_ID), pa.array(starts + row["start"]), pa.array(lengths[some]),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends[some].tolist())], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids before the document in the whole set), n_tokens, ids (little-endian unsigned 32-bit)."""
    segments = spark.read.schema(SEGMENT).parquet(f"{folder}/segments")
    index = spark.read.schema("part int, segment int, start long").parquet(f"{folder}/index")
    return segments.join(index, ["part", "segment"]).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write a file set to a fresh shared folder and read it back."""
    folder = new_path(docs.sparkSession, "token-files")
    write(docs, folder, **options)
    return read(docs.sparkSession, folder)
