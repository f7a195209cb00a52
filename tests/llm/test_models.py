"""Language ID, near copies, neighbours and the language model against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from common import AWKWARD, awkward_documents, empty_documents
from pyspark.sql import functions as F

from sourceloom.llm import ann, langid, lm, queries, simhash

FOLDER = "/root/testdata/sf0.001"


def documents(spark, folder=FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet")


# language


def test_language_query(spark):
    rows = queries.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    langs = {r["doc_id"]: r["lang"] for r in documents(spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_awkward(spark):
    prototypes = langid.train(documents(spark))
    assert sorted(prototypes) == ["de", "en", "es", "fr"]
    docs = awkward_documents(spark)
    got = {r["doc_id"]: r["l"] for r in langid.predict(docs, prototypes, output="l").collect()}
    for k, text in enumerate(AWKWARD):
        letters = any(c.isalpha() for c in text or "")
        assert (got[k]["lang_pred"] == "und") == (not letters)
    nothing = langid.train(empty_documents(spark))
    assert nothing == {} and {r["l"]["lang_pred"] for r in langid.predict(docs, nothing, output="l").collect()} == {"und"}
    assert langid.keep(empty_documents(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep(unlabelled).count() == 0 and langid.keep(unlabelled).columns == unlabelled.columns


def test_text_vector_is_the_sum_of_its_ngrams():
    profiles, text = langid.Profiles(64, 3, block=5), "Abc, abé a"
    want = np.zeros(64)
    padded = " abc abé a "
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        if b != " ":
            x, y, z = (profiles.letters(np.array([0 if s == " " else ord(s)]))[0].astype(float) for s in (a, b, c))
            want += np.roll(x, 2) * np.roll(y, 1) * z
    assert (profiles.vectors(["", text, "x"])[1] == want).all()


# near copies


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(prints):
    """Root of each fingerprint under links of three bits."""
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    prints = sorted(prints)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {p: root(p) for p in prints}


@pytest.mark.parametrize("source", ["documents", "awkward"])
def test_components(spark, source):
    docs = documents(spark) if source == "documents" else awkward_documents(spark)
    prints = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    roots = groups({p for _, p in prints})
    smallest = {}
    for d, p in prints:
        if d is not None:
            smallest[roots[p]] = min(d, smallest.get(roots[p], d))
    got = Counter((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in simhash.components(docs).collect())
    assert got == Counter((d, p, smallest.get(roots[p])) for d, p in prints)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots.values()))


@pytest.mark.parametrize("hot_rows", [20_000, 5])
def test_links_connect_as_all_pairs_do(spark, hot_rows):
    rng, prints = np.random.default_rng(4), set()
    for center in rng.integers(0, 2**63, 40):
        for _ in range(12):
            x = int(center)
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(bit)
            prints.add(x)
    prints |= {5 << 32 | k for k in range(200)} | {0, 2**64 - 1}
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fingerprint long")
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for r in simhash.links(df, hot_rows).collect():
        a, b = r["a"] % 2**64, r["b"] % 2**64
        assert (a ^ b).bit_count() <= 3
        parent[root(a)] = root(b)
    want = groups(prints)
    assert len({root(p) for p in prints}) == len(set(want.values()))
    assert len({(root(p), want[p]) for p in prints}) == len(set(want.values()))


def test_hot_neighbour_keys_are_split(spark, monkeypatch):
    """A half of more than hot_rows fingerprints makes the keys with one more bit hot as well."""
    others = np.random.default_rng(6).choice(2**32, 300, replace=False).tolist()
    df = spark.createDataFrame([(0x0F0F0F0F << 32 | x,) for x in others], "fingerprint long")

    def sizes(batches):
        import pyarrow as pa
        from collections import Counter
        found = Counter((k, p) for batch in batches for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_pydict({"a": [k for k, _ in found], "b": list(found.values())}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    monkeypatch.setattr(simhash, "_links", sizes)
    rows = simhash.links(df, 100).collect()
    assert rows and max(r["b"] for r in rows) <= 100
    whole = simhash.links(df, 1_000).collect()
    assert sum(r["b"] == 300 for r in whole) == 17  # the half and its 16 neighbours


def test_dedup_empty(spark):
    assert simhash.dedup(empty_documents(spark)).count() == 0
    assert simhash.components(empty_documents(spark)).count() == 0


# neighbours


def exact(rows, is_query, k=5):
    usable = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None for x in v)]
    usable = [(i, v) for i, v in usable if np.isfinite(v).all() and v.any()]
    out = {}
    for q, x in usable:
        if is_query(q):
            scored = sorted((-(float(np.sum(v * x)) / (np.linalg.norm(v) * np.linalg.norm(x))), i) for i, v in usable if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_small_tables_are_searched_whole(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    want = exact([(r["vec_id"], r["embedding"]) for r in table.collect()], lambda i: i % 50 == 0)
    got = {}
    for r in queries.op5_nearest_neighbours(spark, FOLDER).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want)
    for q, best in want.items():
        assert [got[q][k + 1][0] for k in range(5)] == [i for i, _ in best]
        assert all(abs(got[q][k + 1][1] - s) < 1e-12 for k, (_, s) in enumerate(best))


def test_larger_tables_use_the_forest(spark, tmp_path):
    vectors = np.random.default_rng(3).standard_normal((6_000, 64))  # a shard of more rows than are searched whole
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    unit, got = vectors / np.linalg.norm(vectors, axis=1, keepdims=True), {}
    for r in queries.op5_nearest_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: set(np.argsort(-(unit @ unit[q]))[1:6].tolist()) for q in range(0, 6_000, 50)}
    assert set(got) == set(want)
    assert 0.9 <= np.mean([len(got[q] & best) / 5 for q, best in want.items()]) < 1  # a whole scan would find all


def test_recall_over_shards(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r["vec_id"], r["embedding"]) for r in table.collect()], lambda i: i % 50 == 0)
    got = {}
    for r in ann.search(table, F.col("vec_id") % 50 == 0, shard_rows=700, least=50).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {i for i, _ in best}) / 5 for q, best in want.items()]) >= 0.9


def test_neighbours_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (50, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("rank", "score", "dims", "shard", "id")})
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect()}
    assert [got[0, k] for k in range(1, 5)] == [(1, 1.0), (2, 1.0), (3, 0.0), (50, -1.0)]
    assert [got[50, k][0] for k in range(1, 5)] == [3, 0, 1, 2] and len(got) == 8
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(300)], "vec_id long, embedding array<float>")
    got = ann.search(same, F.col("vec_id") % 50 == 0, shard_rows=40, least=1).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect()
    assert {r["query_id"]: sorted(r["v"]) for r in got} == {q: [x for x in range(6) if x != q][:5] for q in range(0, 300, 50)}


def test_repeated_queries_are_ranked_once(spark):
    near = [(k, [1.0, k / 100]) for k in range(1, 9)]
    rows = [(0, [1.0, 0.0]), (0, [1.0, -0.0]), (0, [1.0, 0.0]), *near, (3, [1.0, 0.03]), (50, [1.0, 0.0]), (50, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard_rows in (32_768, 4):
        got = Counter((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows).collect())
        assert sorted((r, v) for q, r, v in got if q == 0) == [(1, 50), (2, 1), (3, 2), (4, 3), (5, 3)]
        # two vectors under one id are two queries: both have five ranks
        first, second = [(1, 0), (2, 0), (3, 0), (4, 1), (5, 2)], [(1, 8), (2, 7), (3, 6), (4, 5), (5, 4)]
        assert Counter((r, v) for q, r, v in got.elements() if q == 50) == Counter(first + second) and max(got.values()) == 1


# language model


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def check_base(rows, docs, learns):
    counts = Counter(w for d, t in docs if learns(d) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in docs:
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens(t))
        want[d, not learns(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want


def test_language_model_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    rows = queries.op7_language_model(spark, FOLDER).collect()
    check_base(rows, docs, lambda d: zlib.crc32(str(d).encode()) % 7 != 2)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] <= 0 for r in rows)


@pytest.mark.parametrize("block_tokens, bucket_entries", [(1, 3), (10**6, 10**6)])
def test_language_model_awkward(spark, block_tokens, bucket_entries):
    docs = awkward_documents(spark)
    rows = lm.score(docs, F.col("doc_id") % 3 != 0, block_tokens=block_tokens, bucket_entries=bucket_entries).collect()
    check_base(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], lambda d: d is None or d % 3 != 0)
    none = lm.score(docs, F.lit(False)).collect()
    assert {r["score"] for r in none} == {0.0} and {r["train_tokens"] for r in none} == {0}
    assert lm.score(empty_documents(spark), F.lit(True)).count() == 0


def test_weights_maximise_the_held_out_likelihood():
    events = {(2, -4, 40): 50, (2, lm.NOTHING, 30): 30, (2, lm.NOTHING, lm.NOTHING): 5, (0, lm.NOTHING, 20): 7}
    weights = lm.learn_weights(events, 10_000, 500)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 2] == 0 and (weights >= 0).all()

    def likelihood(mix):
        parts = {(-4, 40): (1 / 501, 2**10 / 9999, 0.5), (lm.NOTHING, 30): (1 / 501, 2**7.5 / 9999, 0), (lm.NOTHING, lm.NOTHING): (1 / 501, 0, 0)}
        return sum(n * math.log(np.dot(mix, parts[q2, q1])) for (b, q2, q1), n in events.items() if b == 2)
    best = likelihood(weights[2])
    for shift in ([0.02, -0.01, -0.01], [-0.01, 0.02, -0.01], [-0.005, -0.01, 0.015]):
        moved = weights[2] + np.array(shift)
        if (moved > 0).all():
            assert likelihood(moved) < best
