"""Ranked search against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from common import awkward_documents, empty_documents

from sourceloom.llm import lexical

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, score string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    found = [(d, Counter(t), len(t)) for d, t in ((d, terms(t)) for d, t in docs) if t]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, counts in asked.items():
        scored = []
        for d, c, n in found:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in counts.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if gone else d, -s) for r, (s, gone, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def check(spark, docs, items, **options):
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string") if isinstance(docs, list) else docs,
                         spark.createDataFrame([(*i, "clash") for i in items], ITEMS), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] if not isinstance(docs, list) else docs
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, items, options.get("k", 10))


def words(rng, n, size=300):
    return " ".join(f"w{int(size * rng.random() ** 3)}" for _ in range(n))


@pytest.mark.parametrize("options", [{}, {"segment_docs": 50, "segment_pairs": 400, "k": 3}, {"block_terms": 20, "segment_docs": 64}])
def test_against_all_scores(spark, options):
    rng = random.Random(5)
    docs = [(d, words(rng, rng.choice([1, 3, 40, 300]))) for d in range(900)] + [(d, "w0 copy") for d in range(1000, 1100)]
    items = [(i, words(rng, rng.choice([1, 2, 8, 30, 200]))) for i in range(25)] + [(30, "nothing here is known"), (31, "copy")]
    check(spark, docs, items, **options)


def test_awkward_tables(spark):
    items = [(1, "word a Aa"), (1, "word a Aa"), (2, None), (3, ""), (None, "same text"), (4, "straße"), (4, "中文 word"), (5, " ., ")]
    check(spark, awkward_documents(spark), items)
    check(spark, [(1, "ab\x00cd_ef é7 " + "x" * 10_000), (None, "AB cd"), (1, "ab")], [(1, "AB-cd EF É7 é7 " + "x" * 10_000)])
    check(spark, [(k, f"t{k % 7} " * 200_000) for k in range(3)], [(1, "t0 t1")])


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(empty_documents(spark), items).collect() == []
    assert lexical.search(awkward_documents(spark), items.limit(0)).collect() == []
    check(spark, [(1, None), (2, " . ")], [(1, "a")])


def test_masks_and_bounds():
    rng = np.random.default_rng(1)
    has = rng.random((130, 400)) < 0.02
    docs, group, masks = lexical.masks_of([np.flatnonzero(r) for r in has], 400)
    assert (docs == np.flatnonzero(has.any(axis=0))).all()
    assert len({tuple(has[:, d]) for d in docs}) == len(masks) == group.max() + 1
    most = rng.integers(0, 10**12, 130)
    assert (lexical.bounds_of(masks, most)[group] == has[:, docs].T @ most).all()


def test_search_stops_early():
    """A rare term decides: documents with common terms only are never scored."""
    rng = random.Random(3)
    texts = [f"common {'also ' * (d % 3)}{words(rng, 20)}" + (" rare" * (d % 100 == 0)) for d in range(5_000)]
    numbers = {b"common": 0, b"also": 1, b"rare": 2}
    import pyarrow as pa
    shared = type("Shared", (), {"value": numbers})
    batch = pa.RecordBatch.from_arrays([pa.array(range(5_000)), pa.array(texts)], names=["doc_id", "text"])
    rows = [r for b in lexical._segments(shared, 10_000, 10**9)([batch]) for r in b.to_pylist()]
    segment = lexical.Segment(rows[0], 5_000, rows[0]["n_terms"])
    df = dict(zip(rows[0]["terms"], rows[0]["sizes"]))
    best, scored = lexical.best_of(segment, [(t, lexical.weight(5_000, df[t])) for t in df], 10, [])
    assert len(best) == 10 and scored < 100
