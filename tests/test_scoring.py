"""Metrics and bootstrap on the four hand-counted cases."""

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import bootstrap as B
from sourceloom.operators import scoring as M

GOLD = [("t1", "a", "true", False, True, [["r1"]]), ("t2", "b", "true", False, True, [["r2"]]),
        ("f1", "c", "false", True, True, [["r3"]]), ("f2", "d", "false", True, False, [])]
PRED = [("t1", "true", [1.0, 0.0, 0.0, 0.0], "resolved", ["r1"]), ("t2", "unverifiable", [.25] * 4, "unresolved", []),
        ("f1", "false", [0.0, 1.0, 0.0, 0.0], "resolved", ["r3"]), ("f2", "true", [1.0, 0.0, 0.0, 0.0], "resolved", ["made-up"])]
EDGES = "id string, from string, to string, relation string"


def facts(spark, pred=PRED):
    g = spark.createDataFrame(GOLD, "id string, event_id string, truth string, high_risk boolean, traceable boolean, acceptable_roots array<array<string>>")
    p = spark.createDataFrame([(i, d, *map(float, pr), s, r) for i, d, pr, s, r in pred],
                              "id string, decision string, p_true double, p_false double, p_disputed double, p_unverifiable double, source_status string, roots array<string>")
    gold = spark.createDataFrame([("t1", "t1", "r1", "cites"), ("t2", "t2", "r2", "cites"), ("f1", "f1", "r3", "quotes")], EDGES)
    mine = spark.createDataFrame([("t1", "t1", "r1", "cites"), ("f1", "f1", "r3", "quotes"), ("f2", "f2", "made-up", "cites")], EDGES)
    ev = spark.createDataFrame([("t1", 1, "supports", "wire", True, "supports", "x"), ("t1", 2, "supports", "wire", True, "supports", "x"),
                                ("t1", 3, "neutral", "interview", True, "supports", "y"), ("f1", 4, "contradicts", "record", True, "contradicts", "z")],
                               "id string, evidence int, gold_stance string, gold_origin string, reported boolean, stance string, origin string")
    return M.case_facts(g.join(p, "id"), gold, mine, ev, F.col("id"))


def test_hand_counted_metrics(spark):
    m = M.metrics(facts(spark)).first().asDict()
    assert (m["VP"], m["FR"], m["TR"], m["HFAR"]) == (.5, .5, .5, .5)
    assert m["SR"] == pytest.approx(2 / 3) and m["EN"] == pytest.approx(2 / 3)
    assert (m["CA"], m["brier"], m["ECE10"], m["duplicate_pair_f1"]) == (.65625, .6875, .4375, 1.0)
    assert m["score"] == pytest.approx(25 * .5 ** .6 * (2 / 3) ** .3 * .65625 ** .1)
    w = spark.range(1).select(M.wilson(F.lit(1), F.lit(2)).alias("w")).first()["w"]
    assert (round(w["low"], 4), round(w["high"], 4)) == (.0945, .9055)


def test_zero_denominator_is_null(spark):
    pred = [(i, "unverifiable", p, "unresolved", []) for i, _, p, _, _ in PRED]
    m = M.metrics(facts(spark, pred)).first()
    assert m["VP"] is None and m["score"] is None and m["FR"] == 1.0


def test_root_without_path_is_not_correct(spark):
    f = facts(spark, [(i, d, p, s, ["r3"] if i == "t1" else r) for i, d, p, s, r in PRED])
    assert f.filter("id = 't1'").first()["source_correct"] == 0


def test_identical_runs_have_zero_interval(spark):
    f = facts(spark)
    out = {r["metric"]: r for r in B.event_bootstrap(f, f, draws=50, seed=0).collect()}
    acc = out["classification_accuracy"]
    assert (acc["delta"], acc["low"], acc["high"], acc["valid_draws"]) == (0.0, 0.0, 0.0, 50)
    # Some draws hold no accepted case, so VP has no interval.
    assert out["VP"]["low"] is None and 30 < out["VP"]["valid_draws"] < 50
    assert out["EN"]["valid_draws"] < out["VP"]["valid_draws"]
    assert out["HFAR"]["preferred_direction"] == "lower" and out["VP"]["preferred_direction"] == "higher"


def test_one_event_has_no_interval(spark):
    f = facts(spark).withColumn("event_id", F.lit("only"))
    rows = B.event_bootstrap(f, f, draws=20).collect()
    assert all(r["low"] is None and r["valid_draws"] == 0 for r in rows)


def test_weighted_sums_equal_duplicated_rows(spark):
    f = facts(spark)
    twice = M.metrics(f.unionByName(f)).first().asDict()
    once = M.metrics(f).first().asDict()
    assert all(twice[k] == pytest.approx(once[k]) for k in once)


def test_seed_fixes_the_draws(spark):
    events = spark.createDataFrame([(f"e{i}",) for i in range(30)], "event_id string")
    a = sorted(map(tuple, B.multiplicities(events, 25, 3).collect()))
    assert a == sorted(map(tuple, B.multiplicities(events, 25, 3).collect())) and a != sorted(map(tuple, B.multiplicities(events, 25, 4).collect()))
    totals = {}
    for draw, _, n in a:
        totals[draw] = totals.get(draw, 0) + n
    assert set(totals.values()) == {30} and len(totals) == 25
