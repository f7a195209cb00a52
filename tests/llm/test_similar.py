"""Near copies by similarity against all pairs."""

import numpy as np
import pytest
from common import awkward_documents, empty_documents

from sourceloom.llm import similar


def shingle_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def alike(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


class Sets:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def root(self, n):
        while self.parent[n] != n:
            n = self.parent[n]
        return n

    def join(self, a, b):
        self.parent[self.root(a)] = self.root(b)


def left_by_similarity(rows):
    """The smallest doc_id of each group of texts, all pairs compared."""
    texts = sorted({t or "" for _, t in rows})
    found, sets = Sets(texts), {t: shingle_set(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if alike(sets[a], sets[b]):
                found.join(a, b)
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(found.root(t or ""), d)
    return sorted(first.values(), key=lambda d: (d is None, d or 0))


@pytest.mark.parametrize("source", ["documents", "awkward"])
def test_dedup_is_that_of_all_pairs(spark, source):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet") if source == "documents" else awkward_documents(spark)
    kept = similar.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda d: (d is None, d or 0)) == left_by_similarity(
        [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert similar.dedup(empty_documents(spark)).count() == 0


def edited(rng, words, share):
    """A copy with runs of words replaced, so that about ``share`` of its shingles stay."""
    words = list(words)
    for at in rng.choice(len(words) - 5, max(1, round((1 - share) * len(words) / 9)), replace=False):
        words[at] = f"w{rng.integers(1 << 30)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(spark):
    rng, texts = np.random.default_rng(3), []
    for _ in range(60):
        base = [f"v{x}" for x in rng.integers(0, 400, rng.integers(60, 400))]
        texts += [" ".join(base)] + [edited(rng, base, share) for share in (0.98, 0.94, 0.9, 0.85)]
    hub = [f"h{x}" for x in rng.integers(0, 400, 300)]
    texts += [edited(rng, hub, 0.97) for _ in range(150)]
    return list(enumerate(texts))


def test_planted_copies(spark, copies):
    """Recall over all pairs alike, and no link between others; a hub of copies is one group."""
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    want, got = left_by_similarity(copies), sorted(r["doc_id"] for r in similar.dedup(df).collect())
    assert set(want) <= set(got) and len(got) - len(want) <= 0.05 * (len(copies) - len(want))
    assert sum(d >= 300 for d in got) == sum(d >= 300 for d in want)


@pytest.mark.parametrize("hot_rows", [4_000, 8])
def test_hot_keys_are_cut_without_loss(spark, copies, hot_rows):
    """Blocks in pairs connect what whole keys connect."""
    texts = [t for _, t in copies[250:]]
    rows = [(i, *map(bytearray, similar.wide_print(similar.shingles(t, 5)))) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "node long, print binary, close binary")
    found, want = Sets(range(len(texts))), Sets(range(len(texts)))
    prints = [int.from_bytes(r[1], "little") for r in rows]
    keys = [{(k, s) for k, s in keys_of(r)} for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= similar.TIERS[-1] and keys[i] & keys[j]:
                want.join(i, j)
    for r in similar.candidates(nodes, hot_rows).collect():
        assert (prints[r["a"]] ^ prints[r["b"]]).bit_count() <= similar.TIERS[-1]
        found.join(r["a"], r["b"])
    assert len({found.root(i) for i in range(len(rows))}) == len({want.root(i) for i in range(len(rows))})


def keys_of(row):
    whole, close = int.from_bytes(row[1], "little"), row[2]
    for s in range(similar.SEGMENTS):
        bits = whole >> 32 * s & (1 << similar.BITS) - 1
        for choice in range(1 << similar.FLIPS):
            key = bits
            for f in range(similar.FLIPS):
                key ^= (choice >> f & 1) << close[s * similar.FLIPS + f]
            yield s, key


def test_closer_links_come_first():
    """A row is claimed from within its own cluster, not from one a little farther away."""
    near = np.zeros((4, 4), dtype=np.uint64)
    near[1, 0] = (1 << 40) - 1           # 40 bits from row 0
    near[2, 0] = (1 << 50) - 1           # 10 from row 1
    near[3] = np.uint64(2**64 - 1)       # 256 from row 0
    links = {frozenset(x) for x in similar.forest(near)}
    assert links == {frozenset((1, 2)), frozenset((0, 1))}


def test_long_text(spark):
    text = " ".join(f"x{i % 5000} y{i}" for i in range(150_000))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short one")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar.dedup(df).collect()) == [1, 3]


def test_texts_without_a_copy_are_not_shuffled(spark):
    """Where the list of copies is too large to broadcast, only the texts on it are shuffled."""
    sc = spark.sparkContext
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 2_000)) for _ in range(200)]
    rows = list(enumerate(texts + [texts[0] + " end", texts[1]]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    size = sum(len(t) for _, t in rows)

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before, limit = stages(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(r["doc_id"] for r in similar.dedup(df).collect()) == list(range(200))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum(n for k, n in stages().items() if k not in before) < size / 2
