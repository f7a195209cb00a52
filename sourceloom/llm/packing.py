"""Best-fit packing of token pieces by linear grouping.

Only the histogram of piece lengths, at most ``size`` numbers, reaches the driver.  There:

1. pieces over ``small`` tokens are ranked by length and cut into groups of equal cardinality; each group counts as its longest length;
2. configurations (multisets of groups that fit one sequence) are chosen one after the other: the largest group left,
   filled up as far as possible by a subset-sum search, and used as often as the groups last; a second plan fills up with the
   largest group that fits instead, and the plan with fewer sequences is taken;
3. actual lengths take the places of their groups, which frees the rounding;
4. small lengths go, longest first, into the smallest gap that holds them, or open new sequences.

Everything is done for runs of equal sequences, so the plan has a bounded number of rows: (length, ranks from-to, first
sequence, pieces per sequence, offset).  A piece finds its row by its rank among the pieces of its length; ranks are numbered
per (length, bucket) with bucket totals carried forward, so no task holds all pieces of one length.

Defined cases: null text is a document of one end token; repeated rows are packed one by one; a document longer than
``size`` is cut, its first piece being the shorter one; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tokens import LibraryEncoder, default_path, per_worker
from .workdir import stored

SIZE = 1024
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def cut_lengths(n: int, size: int = SIZE) -> list[int]:
    """Lengths of the pieces of a document of n tokens: the rest first, then whole sequences."""
    rest = n % size
    return ([rest] if rest else []) + [size] * (n // size)


def _pieces(shared, end_id: int, size: int):
    def run(batches):
        import pyarrow as pa
        encoder, tail = shared.value(), np.array([end_id], dtype="<u4").tobytes()
        kinds, names = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()], [c.split()[0] for c in PIECES.split(", ")]
        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, start = encoder.encode(text.as_py()) + tail, 0
                for piece, length in enumerate(cut_lengths(len(ids) // 4, size)):
                    rows.append((doc_id, piece, start, length, ids[4 * start:4 * (start + length)]))
                    start += length
                held += start
                if held > 1_000_000:
                    yield flush()
                    rows, held = [], 0
        yield flush()
    return run


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2,
                 size: int = SIZE, keep: int = 150_000) -> DataFrame:
    """doc_id, piece, start, length, ids of every whole text: no piece is longer than ``size``."""
    shared = per_worker(docs, LibraryEncoder, path or default_path("byte_bpe_50k.json"), keep)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _pieces(shared, end_id, size), PIECES)


def group_sizes(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of nearly equal cardinality, longest first: (rounded length, [(length, count), ...])."""
    total = sum(counts.values())
    target, out, own, held = -(-total // groups) if total else 1, [], [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            take = min(left, target - held)
            own.append((length, take))
            held, left = held + take, left - take
            if held == target or (not left and held and length == min(counts)):
                if out and out[-1][0] == own[0][0]:  # groups of one rounded length are one size to pack
                    out[-1][1].extend(own)
                else:
                    out.append((own[0][0], own))
                own, held = [], 0
    return out


def _fullest(sizes: list[int], demand: list[int], lead: int, room: int) -> dict[int, int]:
    """Groups whose sum fills ``room`` as far as any can: a subset-sum search over bit sets."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for g in range(lead, len(sizes)):
        steps.append((g, reach))
        for _ in range(min(demand[g], room // sizes[g])):
            wider = (reach | reach << sizes[g]) & mask
            if wider == reach:
                break
            reach = wider
        if reach >> room & 1:
            break
    target, used = reach.bit_length() - 1, defaultdict(int)
    for g, before in reversed(steps):
        while not before >> target & 1:
            used[g] += 1
            target -= sizes[g]
    return used


def _largest(sizes: list[int], demand: list[int], lead: int, room: int) -> dict[int, int]:
    """The largest group that fits, again and again."""
    used = defaultdict(int)
    for g in range(lead, len(sizes)):
        n = min(demand[g], room // sizes[g])
        if n:
            used[g] = n
            room -= n * sizes[g]
    return used


def configurations(sizes: list[int], demand: list[int], capacity: int, fill) -> list[tuple[list[tuple[int, int]], int]]:
    """[(group, copies), ...] and how many sequences have it; sizes descend and every demand is met exactly."""
    demand, chosen = list(demand), []
    for lead in range(len(sizes)):
        while demand[lead]:
            demand[lead] -= 1
            used = fill(sizes, demand, lead, capacity - sizes[lead])
            demand[lead] += 1
            used[lead] += 1
            times = min(demand[g] // n for g, n in used.items())
            for g, n in used.items():
                demand[g] -= n * times
            chosen.append((sorted(used.items()), times))
    return chosen


class Plan:
    """Rows (length, first rank, end rank, first sequence, pieces per sequence, offset)."""

    def __init__(self, counts: dict[int, int], size: int, small: int, groups: int, fill):
        self.size, self.rows, self.sequences = size, [], 0
        self.ranked: dict[int, int] = defaultdict(int)  # pieces of each length that have a place
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: runs (first sequence, count)
        large = {n: c for n, c in counts.items() if n > small}
        self._place_large(group_sizes(large, groups), fill)
        for length in sorted((n for n in counts if n <= small), reverse=True):
            self._best_fit(length, counts[length])

    def _row(self, length: int, count: int, first: int, per: int, offset: int) -> None:
        at = self.ranked[length]
        self.rows.append((length, at, at + count, first, per, offset))
        self.ranked[length] = at + count

    def _place_large(self, groups: list, fill) -> None:
        members = [[list(run) for run in own] for _, own in groups]
        for used, times in configurations([g[0] for g in groups], [sum(c for _, c in g[1]) for g in groups], self.size, fill):
            slots = [g for g, n in used for _ in range(n)]
            runs = [(self.sequences, times, 0)]
            self.sequences += times
            for g in slots:  # actual lengths in place of the rounded one; runs split where the length changes
                split = []
                for first, count, filled in runs:
                    while count:
                        length, left = members[g][0]
                        take = min(count, left)
                        self._row(length, take, first, 1, filled)
                        split.append((first, take, filled + length))
                        first, count = first + take, count - take
                        members[g][0][1] -= take
                        if not members[g][0][1]:
                            members[g].pop(0)
                runs = split
            for first, count, filled in runs:
                self._free(self.size - filled, first, count)

    def _free(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            self.gaps[gap].append((first, count))

    def _best_fit(self, length: int, count: int) -> None:
        open_gaps = sorted(self.gaps)
        while count:
            at = bisect.bisect_left(open_gaps, length)
            if at == len(open_gaps):
                gap, fresh = self.size, -(-count // (self.size // length))
                first, bins = self.sequences, fresh
                self.sequences += fresh
            else:
                gap = open_gaps[at]
                first, bins = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    del self.gaps[gap]
                    open_gaps.pop(at)
            per, offset = gap // length, self.size - gap
            full = min(bins, count // per)
            if full:
                self._row(length, full * per, first, per, offset)
                self._free(gap - per * length, first, full)
                count -= full * per
            if full < bins:
                rest = min(count, per)
                if rest and full < bins:
                    self._row(length, rest, first + full, rest, offset)
                    self._free(gap - rest * length, first + full, 1)
                    count -= rest
                    full += 1
                self._free(gap, first + full, bins - full)


def best_plan(counts: dict[int, int], size: int = SIZE, small: int = SIZE // 8, groups: int = 4096) -> Plan:
    """The plan with fewer sequences of those by the two ways to choose configurations."""
    return min((Plan(counts, size, small, groups, fill) for fill in (_fullest, _largest)), key=lambda p: p.sequences)


def _placer(rows: np.ndarray):
    """Adds sequence_id and offset by the piece's length and rank."""
    def run(batches):
        import pyarrow as pa
        key = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = rows[np.searchsorted(key, length.astype(np.int64) << 48 | rank, side="right") - 1]
            within = rank - row[:, 1]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(row[:, 3] + within // row[:, 4]),
                 pa.array(row[:, 5] + within % row[:, 4] * length)], names=[*names, "sequence_id", "offset"])
    return run


def place(pieces: DataFrame, size: int = SIZE, small: int = SIZE // 8, groups: int = 4096,
          bucket_rows: int = 20_000) -> DataFrame:
    """The pieces (doc_id, piece, length and any further columns) with sequence_id and offset.

    ``pieces`` is read several times: hand over a written table, without the ids if these are not needed beside the places.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(sorted(best_plan(counts, size, small, groups).rows), dtype=np.int64).reshape(-1, 6)
    buckets = 1 + sum(counts.values()) // bucket_rows
    others = [c for c in pieces.columns if c not in ("doc_id", "piece", "length")]
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "length", *others), F.lit(buckets)).cast("int"))
    totals = keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", *others)
    ranked = keyed.withColumn("_at", F.row_number().over(inside) - 1).join(bases, ["length", "_bucket"])
    columns = [c for c in pieces.columns if c != "rank"]
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.select(*columns, (F.col("_base") + F.col("_at")).alias("rank")).mapInArrow(
        _placer(plan), f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2,
         size: int = SIZE) -> DataFrame:
    """Places of all pieces of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are encoded once; the digests and lengths of the pieces, some 40 bytes each, are what later passes read.
    """
    digests = token_pieces(docs, doc_id, text, path, end_id, size).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(stored(digests, "pieces"), size)
