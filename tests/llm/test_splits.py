import random

import pytest

from pagewright.llm import splits as sp


def brute(n, edges):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[top(a)] = top(b)
    return [top(x) for x in range(n)]


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 79), rng.randint(0, 79)) for _ in range(60)] + [(99, k) for k in range(80, 99)]
    df = spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in edges] + [("00", None)], "u string, v string")
    labels = {int(r.vertex): r.label for r in sp.components(df).collect()}
    want = brute(100, edges)
    assert all((labels[a] == labels[b]) == (want[a] == want[b]) for a in labels for b in labels)
    assert sp.components(df.limit(0)).count() == 0


def test_groups_and_shares(spark):
    rows = [(f"b{i:03}", f"a{i // 3}" if i % 7 else None, "s1" if i in (0, 299) else None) for i in range(300)] + [(None, "a1", None), ("b000", "a0", "s1")]
    df = spark.createDataFrame(rows, "book string, author string, series string")
    g = {r.record: r.group for r in sp.record_groups(df, "book", {"a": "author", "s": "series"}).collect()}
    assert len(g) == 300 and g["b299"] == g["b001"] != g["b003"]
    sizes = spark.createDataFrame([(x, list(g.values()).count(x)) for x in set(g.values())], "group string, weight long")
    out = sp.assign_splits(sizes, [("train", 0.7), ("test", 0.3)]).collect()
    assert len(out) == len(set(g.values()))
    assert abs(sum(r.weight for r in out if r.split == "train") / 300 - 0.7) < 0.03


@pytest.mark.parametrize("weights", [[850] + [1] * 150, [300, 200, 90, 80, 40] + [3] * 60 + [1] * 110, [7] * 100, [1]])
def test_shares_hold_with_groups_of_any_size(spark, weights):
    df = spark.createDataFrame([(f"g{i}", w) for i, w in enumerate(weights)], "group string, weight long")
    targets = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
    got = {r.group: r for r in sp.assign_splits(df, targets).collect()}
    assert len(got) == len(weights)
    held = {s: sum(r.weight for r in got.values() if r.split == s) for s, _ in targets}
    fit = max(weights[0] / sum(weights) - 0.8, 0) + 0.05 if len(weights) > 1 else 1
    assert all(abs(held[s] / sum(weights) - x) <= fit for s, x in targets)


def test_more_splits_than_a_thousand_and_none(spark):
    df = spark.createDataFrame([(f"g{i}", 1) for i in range(1500)], "group string, weight long")
    out = sp.assign_splits(df, [(f"s{i}", 1 / 1500) for i in range(1500)])
    assert out.select("split").distinct().count() > 1400
    assert sp.assign_splits(df, []).where("split is null").count() == 1500
    assert sp.assign_splits(df.limit(0), targets=[("a", 1.0)]).count() == 0
