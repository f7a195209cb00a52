"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of two orders and a uniform part are mixed::

    p(w | h) = l2 c(h, w) / c(h)  +  l1 c(w) / N  +  l0 / (V + 1)

with one set of weights per bucket of the context's frequency c(h) (powers of two).  The weights are learned by expectation
maximisation on held-out counts: each training token is scored with its own occurrence deleted from all counts.

Texts become blocks of tokens with numbers local to the block.  Each block asks once for every different word and word
pair it holds, and brings its own training counts along; a bucket of the 64-bit hash space adds up all blocks' counts and answers
in the order asked.  So counts are summed before they are shuffled, a frequent word or pair is one entry per block, and
neither texts nor counts meet in one task: a task holds one block, or one hash bucket of about ``bucket_entries`` entries.  The
number of (block, bucket) rows is the product of both; enlarge both for very large corpora.

Two n-grams with one 64-bit hash would share a count (chance about n^2 / 2^65 for n different n-grams).

Defined cases: null texts have only the end token; null doc_ids count as training documents; without training
documents every probability is 1; repeated rows are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workdir import stored

NO_ID = -(1 << 63)
BUCKETS = 24  # of context frequency: 0 for unseen, then powers of two
QUARTERS = 4  # held-out estimates are binned by quarters of a power of two
NOTHING = -1_024  # bin of a zero estimate; others lie above, and below 1,024

BLOCK = ("block long, n_tokens long, n_train long, n_train_docs long, doc_ids binary, train binary, lengths binary, tokens binary, "
         "hashes binary")
ASK = "bucket int, block long, kind int, keys binary, counts binary"
ANSWER = "block long, kind int, bucket int, counts binary, known long"
COUNTED = ("block long, known long, doc_ids binary, train binary, lengths binary, tokens binary, words binary, pairs binary, "
           "events array<struct<bucket:int,q2:int,q1:int,n:long>>")


def squeeze(values: np.ndarray) -> bytes:
    """Byte planes, compressed: planes of small numbers are mostly zero."""
    import zstandard
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def spread(data: bytes, kind: str) -> np.ndarray:
    """Inverse of ``squeeze``."""
    import zstandard
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs of 64-bit hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ b >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def specials() -> tuple[int, int]:
    """Hashes of the end token and of the start context: of strings that no word equals."""
    from xxhash import xxh64_intdigest
    return xxh64_intdigest(b"", 0), xxh64_intdigest(b" ", 0)


def _blocks(block_tokens: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest
        base, number, end = TaskContext.get().partitionId() << 32, 0, specials()[0]
        local, parts, ids, train, lengths, held = {b"": 0}, [], [], [], [], 0

        def flush():
            hashes = np.array([end, *(xxh64_intdigest(w, 0) for w in local if w)], dtype=np.uint64)
            trained = np.array(train, dtype=np.uint8)
            sizes = np.array(lengths, dtype=np.uint32)
            row = [base + number, int(sizes.sum()), int((sizes * trained).sum()), int(trained.sum()),
                   squeeze(np.array(ids, dtype=np.int64)), squeeze(trained), squeeze(sizes), squeeze(np.concatenate(parts)),
                   hashes.tobytes()]
            kinds = [*[pa.int64()] * 4, *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for doc_id, text, learn in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = (text.as_py() or "").encode().lower().split()  # ASCII case and white space only
                for w in set(words).difference(local):
                    local[w] = len(local)
                parts.append(np.array([local[w] for w in words] + [0], dtype=np.uint32))
                ids.append(NO_ID if doc_id is None else doc_id)
                train.append(learn)
                lengths.append(len(words) + 1)
                held += len(words) + 1
                if held >= block_tokens:
                    yield flush()
                    local, parts, ids, train, lengths, held, number = {b"": 0}, [], [], [], [], 0, number + 1
        if ids:
            yield flush()
    return run


def rows_of(batches):
    """The rows of batches as dictionaries, one at a time: a row is a whole block."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


class Block:
    """A block's tokens and different pairs; numbers local to the block have 32 bits."""

    def __init__(self, row, n_words: int):
        self.tokens, self.sizes = spread(row["tokens"], "<u4").astype(np.int32), spread(row["lengths"], "<u4").astype(np.int64)
        self.train = spread(row["train"], "u1").astype(bool)
        self.ends = np.cumsum(self.sizes)
        codes = np.empty(len(self.tokens), dtype=np.int64)
        codes[1:] = self.tokens[:-1]
        codes[np.r_[0, self.ends[:-1]]] = n_words  # the start context
        codes *= n_words + 1
        codes += self.tokens
        codes, pair_of = np.unique(codes, return_inverse=True)
        self.pair_of = pair_of.astype(np.int32)
        self.before, self.word = (codes // (n_words + 1)).astype(np.int32), (codes % (n_words + 1)).astype(np.int32)
        self.n_words = n_words

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the words and of the pairs."""
        learn = np.repeat(self.train, self.sizes)
        return (np.bincount(self.tokens[learn], minlength=self.n_words).astype(np.uint32),
                np.bincount(self.pair_of[learn], minlength=len(self.word)).astype(np.uint32))

    def pair_hashes(self, hashes: np.ndarray) -> np.ndarray:
        with_start = np.r_[hashes, np.array([specials()[1]], dtype=np.uint64)]
        return mix(with_start[self.before], hashes[self.word])


def _asks(bits: int):
    def run(batches):
        import pyarrow as pa
        for row in rows_of(batches):
            hashes = np.frombuffer(row["hashes"], dtype="<u8")
            block = Block(row, len(hashes))
            word_counts, pair_counts = block.counts()
            pairs = block.pair_hashes(hashes)
            del block
            for kind, keys, counts in ((1, hashes, word_counts), (2, pairs, pair_counts)):
                order = np.argsort(keys)
                keys, counts = keys[order], counts[order]
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), dtype=np.int32)
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else []
                rows = [(int(bucket[a]), row["block"], kind, squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), squeeze(counts[a:b]))
                        for a, b in zip(starts, [*starts[1:], len(keys)])]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in ASK.split(", ")])
    return run


def _answer(asks):
    """One bucket's sums, in the order each block asked; ``known`` counts the words with training counts once."""
    import pandas as pd
    out = []
    for kind, rows in asks.groupby("kind"):
        keys = [np.cumsum(spread(k, "<u8"), dtype=np.uint64) for k in rows["keys"]]
        counts = np.concatenate([spread(c, "<u4") for c in rows["counts"]])
        values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, weights=counts, minlength=len(values)).astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        known = int((sums > 0).sum()) if kind == 1 else 0
        for n, (block, bucket, a, b) in enumerate(zip(rows["block"], rows["bucket"], np.r_[0, ends[:-1]], ends)):
            out.append((block, kind, bucket, squeeze(sums[inverse[a:b]]), 0 if n else known))
    return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])


def frequency_bucket(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.minimum(1 + np.log2(np.maximum(counts, 1)).astype(np.int64), BUCKETS - 1), 0)


def _bins(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.clip(np.round(QUARTERS * np.log2(np.where(x > 0, x, 1))), NOTHING + 1, 1_023), NOTHING).astype(np.int64)


def _counted(starts: int):
    """Joins a block with its answers: counts of its words and pairs, and the held-out events of its training tokens."""
    def run(key, rows):
        import pandas as pd
        head = rows[rows["kind"] == 0].iloc[0]
        hashes = np.frombuffer(head["hashes"], dtype="<u8")
        block = Block(head, len(hashes))
        found = {k: np.concatenate([spread(c, "<u8") for c in g.sort_values("bucket")["counts"]]) for k, g in rows[rows["kind"] > 0].groupby("kind")}
        words, pairs = np.empty(len(hashes), dtype=np.uint64), np.empty(len(block.word), dtype=np.uint64)
        words[np.argsort(hashes)] = found[1]  # answers come in the order of the hashes
        pairs[np.argsort(block.pair_hashes(hashes))] = found[2]
        del found
        times = block.counts()[1]
        live = np.flatnonzero(times).astype(np.int32)
        before, word = block.before[live], block.word[live]
        del block
        ch, c2, c1 = np.r_[words, np.uint64(starts)][before].astype(np.float64) - 1, pairs[live].astype(np.float64) - 1, words[word].astype(np.float64) - 1
        # one number per event: bucket, then the two bins
        event = (frequency_bucket(ch) << 22) + (_bins(np.divide(c2, ch, out=np.zeros_like(c2), where=ch > 0)) - NOTHING << 11) + _bins(c1) - NOTHING
        kinds, at = np.unique(event, return_inverse=True)
        n = np.bincount(at, weights=times[live], minlength=len(kinds)).astype(np.int64)
        events = [{"bucket": e >> 22, "q2": (e >> 11 & 2047) + NOTHING, "q1": (e & 2047) + NOTHING, "n": m} for e, m in zip(kinds.tolist(), n.tolist())]
        return pd.DataFrame([(key[0], int(rows["known"].sum()), head["doc_ids"], head["train"], head["lengths"], head["tokens"],
                              squeeze(words), squeeze(pairs), events)], columns=[c.split()[0] for c in COUNTED.split(", ")[:8]] + ["events"])
    return run


def learn_weights(events: dict[tuple[int, int, int], int], n_train: int, vocabulary: int, rounds: int = 50) -> np.ndarray:
    """Weights [bucket, (l0, l1, l2)] by expectation maximisation; buckets without events take those of all events."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not events:
        weights[:] = (1.0, 0.0, 0.0)
        return weights
    keys, counts = np.array(list(events), dtype=np.int64), np.array(list(events.values()), dtype=np.float64)
    parts = np.stack([np.full(len(keys), 1 / (vocabulary + 1)),
                      np.where(keys[:, 2] == NOTHING, 0, 2.0 ** (keys[:, 2] / QUARTERS)) / max(n_train - 1, 1),
                      np.where(keys[:, 1] == NOTHING, 0, 2.0 ** (keys[:, 1] / QUARTERS))], axis=1)

    def fit(chosen: np.ndarray) -> np.ndarray:
        mixed, own, times = np.full(3, 1 / 3), parts[chosen], counts[chosen]
        for _ in range(rounds):
            shares = own * mixed
            mixed = (shares / shares.sum(axis=1, keepdims=True) * times[:, None]).sum(axis=0) / times.sum()
            mixed = np.maximum(mixed, [1e-6, 1e-9, 0])
            mixed /= mixed.sum()
        return mixed

    everything = fit(np.ones(len(keys), dtype=bool))
    for b in range(BUCKETS):
        chosen = keys[:, 0] == b
        weights[b] = fit(chosen) if chosen.any() else everything
    weights[0, 2] = 0  # an unseen context says nothing
    weights[0] /= weights[0].sum()
    return weights


def _scores(weights: np.ndarray, n_train: int, vocabulary: int, starts: int):
    def run(batches):
        import pyarrow as pa
        for row in rows_of(batches):
            words, pairs = spread(row["words"], "<u8").astype(np.float64), spread(row["pairs"], "<u8").astype(np.float64)
            block = Block(row, len(words))
            contexts = np.r_[words, float(starts)][block.before]
            chosen = frequency_bucket(contexts).astype(np.int8)
            p = np.divide(pairs, contexts, out=np.zeros_like(pairs), where=contexts > 0)
            p *= weights[chosen, 2]
            p += weights[chosen, 1] * words[block.word] / max(n_train, 1)
            p += weights[chosen, 0] / (vocabulary + 1)
            del pairs, contexts, chosen
            np.log10(p, out=p)
            base = np.log10((words + 1) / (n_train + vocabulary + 1))
            first = block.ends - block.sizes
            sums = [np.add.reduceat(x[at], first) for x, at in ((p, block.pair_of), (base, block.tokens), ((words > 0).astype(np.int64), block.tokens))]
            ids = spread(row["doc_ids"], "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == NO_ID), pa.array(~block.train), pa.array(block.sizes), pa.array(sums[2]),
                 pa.array(np.full(len(ids), n_train, dtype=np.int64)), pa.array(sums[1]), pa.array(sums[0])],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", block_tokens: int = 2_000_000,
          bucket_entries: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    The model is learned from the rows that ``learn`` holds for (null counts as true); both scores are sums of log10.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))
    blocks = stored(rows.mapInArrow(_blocks(block_tokens), BLOCK), "lm-blocks")
    size = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_train", "n_train_docs")]).first()
    bits = int(max(1, size["n_tokens"] / bucket_entries) - 1).bit_length()
    asks = blocks.mapInArrow(_asks(bits), ASK)
    answers = asks.groupBy("bucket").applyInPandas(_answer, ANSWER)
    heads = blocks.select("block", F.lit(0).alias("kind"), "doc_ids", "train", "lengths", "tokens", "hashes")
    together = heads.unionByName(answers, allowMissingColumns=True)
    counted = stored(together.groupBy("block").applyInPandas(_counted(size["n_train_docs"]), COUNTED), "lm-counted")
    known = counted.agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()["v"]
    summed = counted.select(F.explode("events").alias("e")).groupBy("e.bucket", "e.q2", "e.q1").agg(F.sum("e.n").alias("n")).collect()
    weights = learn_weights({(r["bucket"], r["q2"], r["q1"]): r["n"] for r in summed}, size["n_train"], known)
    return counted.drop("events", "block", "known").mapInArrow(
        _scores(weights, size["n_train"], known, size["n_train_docs"]),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
