"""Merkle manifests against a plain tree in Python."""

import zlib
from hashlib import sha256

from common import awkward_documents, empty_documents
from pyspark.sql import functions as F

from sourceloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """Root of ``nodes`` and, per node, its siblings level by level as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k:k + 16] for k in range(0, len(nodes), 16)]
        for n, i in enumerate(at):
            run = runs[i // 16]
            paths[n].append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
        at, nodes = [i // 16 for i in at], [h("".join(run)) for run in runs]
    return nodes[0], paths


def brute(rows, tampered=lambda row: False):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[s] = own, *tree([leaf(r) for r in own])
    root, above = tree([built[s][1] for s in names])
    out = []
    for s, high in zip(names, above):
        for row, path in zip(built[s][0], built[s][2]):
            folded = leaf((*row[:4], lowered(row[4]))) if tampered(row) else leaf(row)
            for left, right in path + high:
                folded = h(left + folded + right)
            out.append((row[0], leaf(row), built[s][1], root, h("".join(a + b for a, b in path + high)), folded, folded == root))
    return out


def check(spark, rows, tampered=lambda row: False, column=None):
    got = merkle.document_proofs(spark.createDataFrame(rows, SCHEMA), tampered=column).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, tampered), key=key)
    return got


def test_large_groups_and_tampering(spark):
    """One group of two rounds, others at the edges of runs and blocks, more groups than one run holds."""
    sizes = {"hot": 4_500, "a": 1, "b": 2, "c": 16, "d": 17, "e": 256, "f": 257, "Ä": 15, None: 33, "": 1, **{f"s{k}": 1 for k in range(10)}}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((n * 7 % 9_973, source, None if n % 11 == 0 else "en", n, f"Text {n}" if n % 3 else "no capitals é"))
            n += 1
    crc = lambda row: zlib.crc32(str(row[0]).encode()) % 5 == 0
    got = check(spark, rows, crc, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    bad = [r["doc_id"] for r in got if not r["verified"]]
    assert bad and set(bad) == {r[0] for r in rows if crc(r) and lowered(r[4]) != r[4]}


def test_whole_blocks(spark):
    check(spark, [(k, "s", "en", k, "t") for k in range(4_096)])
    check(spark, [(k, "s", "en", k, "t") for k in range(4_097)])


def test_one_leaf_is_root_and_proof_is_empty(spark):
    (row,) = check(spark, [(5, "s", "en", 1, "A")])
    assert row["leaf"] == row["root"] and row["proof"] == h("") and row["verified"]


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None, None), (None, "s", None, None, ""), (1, "s", "", 0, None), (1, "s", "", 0, None), (1, "s", "", 0, "B"),
            (1, "s", "", 0, "x" * 100_000), (-3, "s", "é", None, "中文 \n\x00")]
    check(spark, rows)


def test_awkward_and_empty_tables(spark):
    docs = awkward_documents(spark).withColumn("source", F.lit("s")).withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(1)) \
        .withColumn("key", F.lit("clash")).withColumn("item", F.lit("clash")).withColumn("leaf", F.lit("clash"))
    out = merkle.document_proofs(docs)
    assert out.count() == docs.count() and out.filter("NOT verified").isEmpty()
    assert merkle.document_proofs(empty_documents(spark)).collect() == []


def test_groups_and_root(spark):
    rows = [(k, f"s{k % 3}", "en", k, "t") for k in range(50)]
    manifest = merkle.build(spark.createDataFrame(rows, SCHEMA), F.col("source"), F.col("doc_id"),
                            merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")), F.col("doc_id"))
    want = {r[0]: r[2:4] for r in brute(rows)}
    assert {(r["group"], r["subroot"]) for r in manifest.groups.collect()} == {(f"s{k % 3}", want[k][0]) for k in range(50)}
    assert manifest.root == want[0][1]
