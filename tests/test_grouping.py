"""Independent source groups on hand-made evidence and against union-find."""

import random

from pyspark.sql import functions as F

from sourceloom.operators import grouping as G
from sourceloom.operators.admission import validate_evidence
from sourceloom.operators.skew import hub_lookup, lagged, running_sums, split_lookup

COLS = "claim_id string, round int, id string, publisher_group string, origin_id string, url string, content string, stance string"


def row(claim, rnd, id, stance, publisher=None, origin=None):
    return (claim, rnd, id, publisher or f"pub-{id}", origin or f"org-{id}", f"https://{id}.example.org/x", f"text of {id}", stance)


def decisions(spark, rows, rounds):
    df = spark.createDataFrame(rows, COLS)
    out = G.decision_per_round(df, "claim_id", "round", rounds)
    return {(r["claim_id"], r["upto_round"]): r for r in out.collect()}


def test_policy_cases(spark):
    rows = [row("demo", 1, "a", "supports"), row("demo", 1, "b", "supports"), row("demo", 2, "c", "contradicts"),
            row("copies", 1, "a1", "supports", "one", "o1"), row("copies", 1, "b1", "supports", "one", "o2"), row("copies", 2, "c1", "supports", "two", "o2"),
            row("bridge", 1, "a2", "supports", "p1", "o3"), row("bridge", 1, "b2", "supports", "p2", "o4"), row("bridge", 2, "x2", "neutral", "p1", "o4"),
            row("owner", 1, "a3", "supports", "same"), row("owner", 2, "b3", "contradicts", "same")]
    got = decisions(spark, rows, 2)
    assert got["demo", 1]["decision"] == "supported" and got["demo", 2]["decision"] == "conflicting"
    assert got["copies", 2]["decision"] == "unresolved" and got["copies", 2]["supports"] == 1 and got["copies", 2]["total"] == 1
    # A late bridge lowers independence.
    assert got["bridge", 1]["decision"] == "supported" and got["bridge", 2]["decision"] == "unresolved"
    assert got["owner", 2]["decision"] == "conflicting" and got["owner", 2]["conflicting"] == 1


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(400):03d}", f"n{rng.randrange(400):03d}") for _ in range(330)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)]          # a long chain
    edges += [("hub", f"leaf{i:03d}") for i in range(150)]                 # a hot centre
    want = {k: v for k, v in union_find([(a, b) for a, b in edges if a != b]).items() if k != v}
    df = spark.createDataFrame(edges, "u string, v string")
    assert {r["node"]: r["component"] for r in G.connected(df).collect()} == want


def test_stars_with_hubs(spark):
    """Centres that are the smallest, a middle and the largest node, joined by a chain of hubs."""
    n = 60_000
    ids = spark.range(n).withColumn("k", F.col("id") % 3)
    centre = F.when(F.col("k") == 0, F.lit(-1)).when(F.col("k") == 1, F.lit(n // 2)).otherwise(F.lit(n + 5))
    edges = ids.select(F.col("id").alias("u"), centre.cast("long").alias("v")).unionByName(
        spark.createDataFrame([(-1, n // 2), (n + 5, n + 9), (n + 20, n + 21)], "u long, v long"))
    # n // 2 is one of the leaves of the smallest centre or stands between two
    got = {(r["component"], r["n"]) for r in G.connected(edges, hub_rows=1_000).groupBy("component").agg(F.count("*").alias("n")).collect()}
    labels = union_find([(r["u"], r["v"]) for r in edges.collect() if r["u"] != r["v"]])
    want = {}
    for node, root in labels.items():
        if node != root:
            want[root] = want.get(root, 0) + 1
    assert got == set(want.items())


def test_hub_rows_stay_spread(spark):
    """A key with nine of ten rows: the fullest task holds little more than its share, and every row finds its value."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(200_000).select(F.when(F.col("id") % 10 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id").repartition(16)
        table = rows.groupBy("k").agg(F.min("id").alias("m")).filter("k % 3 <> 0")
        out = hub_lookup(rows, "k", table, 200_000)
        most = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        assert most <= 2 * 200_000 / 16
        assert out.exceptAll(rows.join(table, "k", "left")).isEmpty() and out.count() == 200_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_admitted_copies_fold_and_addresses_join(spark):
    """Exact copies become one signature before the graph, and a shared address alone joins two rows."""
    from sourceloom.plans.evidence_queries import admitted
    from sourceloom.plans.registry import Tables
    rows = admitted(Tables(spark, "/root/testdata/sf0.1"))
    signatures, _ = G.source_groups(rows, ["searched_claim"], G.evidence_keys(), id_col="doc_id", carry=G.stance_flags())
    assert signatures.count() < rows.count()
    two = [row("c", 1, "e1", "supports", "p1", "o1"), row("c", 1, "e2", "supports", "p2", "o2")]
    apart, joined = decisions(spark, two, 1), decisions(spark, [(*r[:5], "https://a.example.org/x?utm_source=" + r[3], *r[6:]) for r in two], 1)
    assert apart["c", 1]["supports"] == 2 and joined["c", 1]["supports"] == 1


def test_grouping_ignores_row_order(spark):
    rng = random.Random(5)
    rows = [row("c", 1, f"e{i}", rng.choice(["supports", "contradicts", "neutral"]), f"p{rng.randrange(25)}", f"o{rng.randrange(25)}") for i in range(60)]
    first = decisions(spark, rows, 1)["c", 1]
    rng.shuffle(rows)
    assert decisions(spark, rows, 1)["c", 1] == first


def test_evidence_reasons(spark):
    cols = "searched_claim string, id string, claim_id string, url string, publisher_group string, origin_id string, published_at string, retrieved_at string, content string, quote string, stance string"
    good = ["c", "e", "c", "https://a.example.org/", "p", "o", "2026-09-04T18:00:00Z", "2026-09-05T10:00:00+02:00", "We  saw\nit happen.", "saw it", "supports"]
    rows, want = [tuple(good)], {"e": []}
    for i, (col, value, reasons) in enumerate([
            (4, " ", ["missing_or_empty_publisher_group"]), (2, "d", ["claim_id_mismatch"]), (10, "maybe", ["invalid_stance"]), (3, "ftp://a.b/", ["invalid_url"]),
            (6, "2026-09-04T18:00:00", ["invalid_published_at"]), (7, "2026-09-06T00:00:00Z", ["future_retrieved_at"]), (6, "2026-08-01T00:00:00Z", ["stale_published_at"]),
            (7, "2026-09-04T10:00:00Z", ["retrieved_before_published"]), (9, "we saw", ["quote_not_in_content"])]):
        bad = list(good)
        bad[col], bad[1] = value, f"x{i}"
        rows.append(tuple(bad))
        want[f"x{i}"] = reasons
    claims = spark.createDataFrame([("c", "2026-09-05 12:00:00")], "id string, as_of string").withColumn("as_of", F.col("as_of").cast("timestamp"))
    got = validate_evidence(spark.createDataFrame(rows, cols), claims)
    assert {r["id"]: r["reasons"] for r in got.collect()} == want


def test_split_lookup_equals_join(spark):
    big = spark.createDataFrame([(i % 7 if i % 2 else 99, i) for i in range(400)], "k int, v int")
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m")).filter("k <> 3")
    want = sorted(map(tuple, big.join(small, "k").collect()))
    assert sorted(map(tuple, split_lookup(big, small, ["k"], "n", 50).collect())) == want
    left = sorted(map(str, big.join(small, ["k"], "left").collect()))
    assert sorted(map(str, split_lookup(big, small, ["k"], "n", 50, "left").collect())) == left


def test_bucketed_windows_equal_plain_windows(spark):
    from pyspark.sql import Window as W
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randrange(3), i // 10, i, rng.randrange(100)) for i in range(200)], "k int, b int, t int, v int")
    w = W.partitionBy("k").orderBy("t")
    want = sorted((r["t"], r["s"], r["p"]) for r in df.select("t", F.sum("v").over(w).alias("s"), F.lag("v").over(w).alias("p")).na.fill(-1).collect())
    got = lagged(running_sums(df, ["k"], "b", [F.col("t")], {"s": F.col("v")}), ["k"], "b", F.col("t"), F.col("v"), "p")
    assert sorted((r["t"], r["s"], r["p"]) for r in got.na.fill(-1).collect()) == want


def test_language_groups_against_union_find(spark):
    """The stress case: component counts per language equal an independent union-find."""
    import hashlib
    import __spark_entry__ as entry
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    edges = []
    for d in docs:
        text = " ".join(d["text"].split())
        keys = ("p", f"{d['source']}/{d['n_chars'] // 40}"), ("o", " ".join(text.split(" ")[:5]).lower()), ("h", hashlib.sha256(text.lower().encode()).hexdigest())
        if d["doc_id"] % 19:
            keys += (("u", f"{d['source']}/{d['n_chars']}"),)
        edges += [((d["lang"], "d", str(d["doc_id"])), (d["lang"], *k)) for k in keys]
    roots = union_find(edges)
    want = {}
    for node, root in roots.items():
        if node[1] == "d":
            want.setdefault(node[0], set()).add(root)
    got = {r["lang"]: r["groups"] for r in entry.queries()["language_source_groups"](spark, folder).collect()}
    assert got == {k: len(v) for k, v in want.items()}
