"""Ranked lexical search by presence-mask grouping.

A set of queries ("items") is answered against all documents, in two passes.

1. Texts become segments of up to ``segment_docs`` documents.  A segment keeps, for each term that any item holds, the documents it
   occurs in and how often, and the number of terms of each document.  Texts are read once and never shuffled; counts over all
   documents (with terms, terms, documents per term) are sums over the segments.
2. In each segment and for each item, the bitmaps of the item's terms are laid over each other: every document has the mask of the
   terms it holds.  The documents are grouped by mask.  A mask's score is at most the sum over its terms of the best that the term gives
   in this segment.  Masks are taken by descending bound, and their documents scored exactly, until the bound is below the k-th score found:
   no document left can enter the list.  A task carries its k best over all its segments; their lists are ranked at the end.

Items are taken in blocks of up to ``block_terms`` terms (an item with more is a block by itself), one block after the other; a block is what
tasks and driver hold of the items, and its terms' document counts what reaches the driver.

Scores: a term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has m = 25 + 75 n N div L; a document's score is the
sum over the item's terms, repeats included, of w * (10^9 tf div (1000 tf + 8 m)).  All but w is in 64-bit integers: n * N must stay below
10^17, as with 10^11 documents of up to a million terms.

Defined cases: null and empty texts, and texts without terms, are no documents and match nothing; items without terms get no rows; equal scores go
to the smaller doc_id, null ones last; repeated rows of the documents are ranked one by one; repeated items are answered once, and rows with one
item_id and different texts are one item of all their terms; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lm import spread, squeeze
from .workdir import stored

NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id, behind all others
SEGMENT = "n_docs long, n_terms long, terms array<int>, sizes array<long>, doc_ids binary, lengths binary, docs binary, times binary"
FOUND = "item int, doc_id long, score long"

# Every byte that is no part of a term is a blank; A to Z are lower-cased; bytes of other characters stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def _segments(shared, segment_docs: int, segment_pairs: int):
    def run(batches):
        import pyarrow as pa
        numbers = shared.value
        ids, lengths, docs, terms, times = [], [], [], [], []

        def flush():
            term, doc, often = (np.array(x, dtype=np.uint32) for x in (terms, docs, times))
            order = np.argsort(term, kind="stable")  # documents stay ascending
            some, sizes = np.unique(term, return_counts=True)
            row = [len(ids), sum(lengths), some.tolist(), sizes.tolist(), squeeze(np.array(ids, dtype=np.int64)),
                   squeeze(np.array(lengths, dtype=np.int64)), squeeze(doc[order]), squeeze(often[order])]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in SEGMENT.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                held = [(numbers[w], n) for w, n in Counter(words).items() if w in numbers]
                docs += [len(ids)] * len(held)
                terms += [t for t, _ in held]
                times += [n for _, n in held]
                ids.append(NO_ID if doc_id is None else doc_id)
                lengths.append(len(words))
                if len(ids) >= segment_docs or len(docs) >= segment_pairs:
                    yield flush()
                    ids, lengths, docs, terms, times = [], [], [], [], []
        if ids:
            yield flush()
    return run


class Segment:
    """Postings of a segment: documents and contributions (without the weight) by term."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids, lengths = spread(row["doc_ids"], "<i8"), spread(row["lengths"], "<i8")
        m = 25 + 75 * lengths * n_docs // n_terms
        docs, times = spread(row["docs"], "<u4").astype(np.int64), spread(row["times"], "<u4").astype(np.int64)
        gain = 1_000_000_000 * times // (1_000 * times + 8 * m[docs])
        ends = np.cumsum(row["sizes"]).astype(np.int64)
        self.postings = {t: (docs[b - n:b], gain[b - n:b]) for t, n, b in zip(row["terms"], row["sizes"], ends.tolist())}
        self.best = {t: int(g.max()) for t, (_, g) in self.postings.items()}


def masks_of(lists: list[np.ndarray], n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents with any term, the number of each one's mask, and the different masks as rows of 64-bit words."""
    words = np.zeros((-(-len(lists) // 64), n_docs), dtype=np.uint64)
    for j, docs in enumerate(lists):
        words[j // 64, docs] |= np.uint64(1 << j % 64)
    docs = np.flatnonzero(words.any(axis=0))
    words = words[:, docs]
    group = np.zeros(len(docs), dtype=np.int64)
    for word in words:
        part, inverse = np.unique(word, return_inverse=True)
        group = np.unique(group * len(part) + inverse, return_inverse=True)[1]
    first = np.zeros(int(group.max()) + 1 if len(group) else 0, dtype=np.int64)
    first[group] = np.arange(len(group))
    return docs, group, words[:, first].T


def bounds_of(masks: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Sum of ``most`` over the terms of each mask, by a table per byte."""
    padded = np.zeros(masks.shape[1] * 64, dtype=np.int64)
    padded[:len(most)] = most
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    at = np.ascontiguousarray(masks.astype("<u8")).view(np.uint8).reshape(len(masks), -1)
    return sum((bits @ padded[8 * b:8 * b + 8])[at[:, b]] for b in range(at.shape[1])) if len(masks) else np.zeros(0, dtype=np.int64)


def best_of(segment: Segment, terms: list[tuple[int, int]], k: int, best: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, -doc_id) of ``best`` and this segment for an item's (term, weight) pairs, and the number of documents scored.

    ``best`` is a heap with its worst entry first.
    """
    held = [(*segment.postings[t], w, w * segment.best[t]) for t, w in terms if w and t in segment.postings]
    if not held:
        return best, 0
    docs, group, masks = masks_of([h[0] for h in held], len(segment.ids))
    bounds = bounds_of(masks, np.array([h[3] for h in held], dtype=np.int64))
    order = np.argsort(-bounds, kind="stable")
    sizes = np.bincount(group, minlength=len(masks))
    members, ends = np.argsort(group, kind="stable"), np.cumsum(sizes)
    at, step, scored = 0, 4 * k, 0
    while at < len(order) and (len(best) < k or bounds[order[at]] >= best[0][0]):
        # masks of at least ``step`` documents together, those out of reach left aside
        upto = at + 1 + int(np.searchsorted(np.cumsum(sizes[order[at:at + step]]), step))
        chosen = order[at:upto]
        if len(best) == k:
            chosen = chosen[bounds[chosen] >= best[0][0]]
        some = np.sort(docs[np.concatenate([members[ends[g] - sizes[g]:ends[g]] for g in chosen.tolist()])])
        scores = np.zeros(len(some), dtype=np.int64)
        for where, gain, w, _ in held:
            pos = np.searchsorted(where, some)
            pos[pos == len(where)] = 0
            hit = where[pos] == some
            scores[hit] += w * gain[pos[hit]]
        scored += len(some)
        low = best[0][0] if len(best) == k else 1
        for n in np.flatnonzero(scores >= low).tolist():
            entry = (int(scores[n]), -int(segment.ids[some[n]]))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
        at, step = upto, 2 * step
    return best, scored


def _search(shared, n_docs: int, n_terms: int, k: int):
    def run(batches):
        import pyarrow as pa
        items, best = shared.value, {}
        for batch in batches:
            for at in range(batch.num_rows):  # one segment in memory at a time
                segment = Segment(batch.slice(at, 1).to_pylist()[0], n_docs, n_terms)
                for number, terms in enumerate(items):
                    best[number] = best_of(segment, terms, k, best.get(number, []))[0]
        rows = [(number, None if -d == NO_ID else -d, score) for number, found in best.items() for score, d in found]
        if rows:
            kinds = [pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in FOUND.split(", ")])
    return run


def item_blocks(items: DataFrame, item_id: str, text: str, block_terms: int) -> Iterator[dict[int | None, Counter]]:
    """Items as counts of their terms, in blocks; the driver holds one at a time."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).filter("text IS NOT NULL").distinct()
    block, size, last = {}, 0, object()
    for row in rows.repartition("item_id").sortWithinPartitions("item_id", "text").toLocalIterator():
        counts = Counter(terms_of(row["text"]))
        if block and row["item_id"] != last and size + len(counts) > block_terms:
            yield block
            block, size = {}, 0
        last = row["item_id"]
        if counts:
            block.setdefault(last, Counter()).update(counts)
            size += len(counts)
    if block:
        yield block


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _answer(docs: DataFrame, block: dict[int | None, Counter], k: int, segment_docs: int, segment_pairs: int) -> DataFrame:
    spark = docs.sparkSession
    ids = list(block)
    numbers = {w: n for n, w in enumerate(sorted(set().union(*block.values())))}
    segments = stored(docs.mapInArrow(_segments(spark.sparkContext.broadcast(numbers), segment_docs, segment_pairs), SEGMENT), "lexical-segments")
    total = segments.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_terms")]).first()
    pairs = segments.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).groupBy("p.terms").agg(F.sum("p.sizes").alias("df"))
    weights = {r["terms"]: weight(total["n_docs"], r["df"]) for r in pairs.collect()}
    asked = [[(numbers[w], n * weights.get(numbers[w], 0)) for w, n in sorted(block[i].items())] for i in ids]
    found = segments.mapInArrow(_search(spark.sparkContext.broadcast(asked), total["n_docs"], max(total["n_terms"], 1), k), FOUND)
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", block_terms: int = 200_000, segment_docs: int = 32_768, segment_pairs: int = 2_000_000) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of highest score above 0 of every item."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    answers = [_answer(rows, block, k, segment_docs, segment_pairs) for block in item_blocks(items, item_id, item_text, block_terms)]
    if not answers:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out
