import random

import pytest

from pagewright.operators import graph, matching, metrics, sampling, sequence, tally
from pagewright.operators.prefix import running_sum


def test_greedy_natively_and_by_sheet(spark):
    rng = random.Random(1)
    rows = [(p, f"e{rng.randint(0, 5)}", f"r{rng.randint(0, 5)}", float(rng.randint(0, 6))) for p in range(6) for _ in range(20)]
    df = spark.createDataFrame(rows, "page int, e string, r string, cost double").distinct()
    a = matching.greedy_by_rounds(df, ["page"], "e", "r", ["cost", "e", "r"])
    b = matching.greedy_by_sheet(df, ["page"], "e", "r", ["cost", "e", "r"])
    assert {tuple(x) for x in a.collect()} == {tuple(x) for x in b.collect()}


def test_detection_matching_and_ap(spark):
    a, b = (0.0, 0.0, 100.0, 100.0), (200.0, 0.0, 300.0, 100.0)
    pred = spark.createDataFrame([(1, 0, 0.9, *a), (1, 1, 0.8, *a), (2, 0, 0.5, *b)], "page int, ord int, score double, x0 double, y0 double, x1 double, y1 double")
    truth = spark.createDataFrame([(1, 0, *a), (3, 0, *b)], "page int, ord int, x0 double, y0 double, x1 double, y1 double")
    hits = {(r.page, r.ord): r.hits for r in matching.match_detections(pred, truth, ["page"], (0.5, 0.99)).collect()}
    assert hits == {(1, 0): [True, True], (1, 1): [False, False], (2, 0): [False, False]}
    both = {r.page: (r.n_a, r.n_b, r.matches, r.agreement) for r in matching.mutual_matches(pred.drop("score"), truth, ["page"], 0.7).collect()}
    assert both == {1: (2, 1, 1, pytest.approx(2 / 3)), 2: (1, 0, 0, 0.0), 3: (0, 1, 0, 0.0)}
    p = spark.createDataFrame([("b", 0.9, 0, True), ("b", 0.5, 1, True)], "k string, score double, ord int, hit boolean")
    t = spark.createDataFrame([("b", 2), ("none", 0)], "k string, truths int")
    assert {r.k: r.ap for r in metrics.average_precision(p, t, ["k"]).collect()} == {"b": pytest.approx(1.0), "none": None}


def test_nearest_rank_is_not_percentile_disc(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("a", None)], "k string, v double")
    assert tally.nearest_rank(df, ["k"], "v", {"q": 0.5}).first().q == 3.0


def test_components_running_sum_and_runs(spark):
    v = spark.createDataFrame([(x,) for x in "abcdefg"], "v string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d"), ("f", "e")], "u string, v string")
    assert {r.vertex: r.label for r in graph.min_label(v, e).collect()} == dict(zip("abcdefg", "aaadeeg", strict=True))
    r = running_sum(spark.range(100).withColumnRenamed("id", "n"), ["n"], "n")
    assert {x.n: x.running for x in r.collect()} == {n: n * (n + 1) / 2 for n in range(100)}
    runs = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 9, 3, 4])], "k int, o int, v double")
    assert sequence.longest_run(runs, ["k"], "o", "v").first().n == 4


def test_anchor_clusters_do_not_chain(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 2.0, 4.0, 6.0])], "k int, o int, v double")
    assert [r.cluster for r in sequence.anchor_clusters(df, ["k"], "v", "o", 2.5).orderBy("o").collect()] == [1, 1, 2, 2]


def test_doubt(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(*[sampling.doubt(F.lit(x)).alias(f"d{i}") for i, x in enumerate((0.5, 0.7, 0.25, 0.95))]).first()
    assert list(r) == [pytest.approx(x, abs=1e-9) for x in (1, 0.5, 0.5, 0)]
