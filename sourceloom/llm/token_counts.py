"""Token counts by rank-synchronous merging of ragged numpy arrays.

New pre-tokens of a batch lie in one flat symbol array with a start per pre-token.  In each round every pre-token merges
its own lowest-ranked neighbouring pair, at all places at once, left to right where places overlap; a pre-token without a
mergeable pair is finished, and its surviving symbols are its tokens.  Counts of recurring pieces are remembered by the worker process.

Defined cases: null text has no bytes and no tokens; special strings inside a text count as one token each; repeated rows
are counted one by one; texts are never cut short; an empty table gives no rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import BYTE_PATTERN, byte_chars, default_path, per_worker, space_pieces, spans_of

NONE = np.int32(2**31 - 1)


class MergeTable:
    """Ranks and products of the merge pairs, as sorted arrays."""

    def __init__(self, spec: dict):
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.base = np.array([vocab[c] for _, c in sorted(byte_chars().items())], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merged_counts(table: MergeTable, parts: list[bytes]) -> np.ndarray:
    """Symbols that survive in each non-empty byte string."""
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    counts = lengths.copy()
    symbols = table.base[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(parts)), lengths)
    ranks = np.full(len(symbols), NONE, dtype=np.int32)  # of the pair that begins at each symbol
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    ranks[inside] = table.rank(symbols[inside], symbols[inside + 1])
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(symbols)])
        lowest = np.minimum.reduceat(ranks, starts)
        counts[owner[starts]] = sizes
        live = np.repeat(lowest != NONE, sizes)
        hit = live & (ranks == np.repeat(lowest, sizes))
        at = np.flatnonzero(hit)
        if not len(at):
            break
        run = np.r_[True, np.diff(at) != 1] | (owner[at] != owner[np.maximum(at - 1, 0)])
        first = np.maximum.accumulate(np.where(run, at, 0))
        at = at[(at - first) % 2 == 0]
        symbols[at] = table.made[ranks[at]]
        live[at + 1] = False
        fresh = np.zeros(len(symbols), dtype=bool)
        fresh[at] = True
        symbols, owner, ranks, fresh = symbols[live], owner[live], ranks[live], fresh[live]
        at = np.flatnonzero(fresh)
        near = np.unique(np.r_[at, at - 1])
        near = near[near >= 0]
        ranks[near] = NONE
        near = near[near + 1 < len(symbols)]
        near = near[owner[near] == owner[near + 1]]
        ranks[near] = table.rank(symbols[near], symbols[near + 1])
    return counts


class Counter:
    """Token counts of texts for one byte-level vocabulary file; remembers recurring pieces."""

    def __init__(self, path: str, keep: int):
        import regex
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.table, self.findall, self.keep = MergeTable(spec), regex.compile(BYTE_PATTERN).findall, keep
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.parts, self.known = {}, {"": 0}

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.keep:
            self.known = {"": 0}
        if len(self.parts) > self.keep:
            self.parts = {}
        known, parts = self.known, self.parts
        cut = [[p for section in self.special.split(t) for p in space_pieces(section)] for t in texts]
        new = {p: self.findall(p) for p in set().union(*cut).difference(known)}
        fresh = list(set().union(*new.values()).difference(parts))
        if fresh:
            parts.update(zip(fresh, merged_counts(self.table, [p.encode() for p in fresh]).tolist()))
        known.update((p, sum([parts[x] for x in found])) for p, found in new.items())
        return [sum([known[p] for p in pieces]) + len(self.special.findall(t)) for pieces, t in zip(cut, texts)]


def _counter(shared):
    def run(batches):
        import pyarrow as pa
        counter = shared.value()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tokens = [n for a, b in spans_of(texts) for n in counter.count(texts[a:b])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
                 limit: int = 1024, keep: int = 800_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text, for a byte-level vocabulary file."""
    shared = per_worker(docs, Counter, path or default_path("byte_bpe_50k.json"), keep)
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _counter(shared), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
