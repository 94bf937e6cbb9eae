import random

import pytest

from pagewright.llm import mixing as mx


def test_flight_keeps_totals():
    rng = random.Random(2)
    size, p = [float(rng.randint(1, 500)) for _ in range(800)], [0.37] * 800
    q = mx.flight(size, p, rng)
    assert sum(0 < x < 1 for x in q) <= 2
    assert sum(q) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(size, q, strict=True)) == pytest.approx(0.37 * sum(size))
    done = mx.landing(size, q, rng)
    assert set(done) <= {0.0, 1.0}
    assert set(mx.landing([3.0] * 5, mx.flight([3.0] * 5, [0.5] * 5, rng), rng)) <= {0.0, 1.0}


def test_inclusion_probabilities_are_kept():
    size = [1.0, 5.0, 9.0, 2.0, 7.0]
    runs = [mx.landing(size, mx.flight(size, [0.3] * 5, r), r) for r in map(random.Random, range(4000))]
    for i in range(5):
        assert sum(x[i] for x in runs) / len(runs) == pytest.approx(0.3, abs=0.03)


def test_few_documents_of_very_different_sizes_still_balance():
    worst = []
    for seed in range(60):
        rng = random.Random(seed)
        size = sorted((float(int(rng.lognormvariate(5, 1.2)) + 1) for _ in range(300)), reverse=True)
        p = [0.43] * 300
        got = mx.landing(size, p, rng)
        worst.append(abs(sum(a for a, x in zip(size, got, strict=True) if x) / (0.43 * sum(size)) - 1))
    assert sum(worst) / len(worst) < 0.001 and max(worst) < 0.01


def test_landing_of_one_and_of_none():
    assert mx.landing([], [], random.Random(1)) == [] and mx.landing([4.0], [0.5], random.Random(1)) in ([0.0], [1.0])
    assert mx.landing([4.0, 1.0], [1.0, 0.0], random.Random(1)) == [1.0, 0.0]


def test_mix_holds_shares(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randint(0, 300)) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    out = mx.mix(docs, targets).toPandas()
    assert not out.doc_id.duplicated().any() and (out.n_tokens > 0).all()
    drawn = (out.n_tokens * out.repeats).groupby(out.source).sum()
    assert (drawn / drawn.sum()).to_dict() == {"a": pytest.approx(0.5 / 0.9, abs=0.002), "b": pytest.approx(0.3 / 0.9, abs=0.002), "c": pytest.approx(0.1 / 0.9, abs=0.002)}
    report = {r.source: r for r in mx.shares(mx.mix(docs, targets), docs, targets).collect()}
    assert report["a"].scaled_share == pytest.approx(0.5 / 0.9) and report["none"].scaled_share == 0 and report["none"].token_error is None
    assert all(abs(r.token_error) < 0.002 and abs(r.actual_share - r.scaled_share) < 0.001 for s, r in report.items() if s != "none")
    most = {"a": 1, "b": 3, "c": 2}
    assert all(r.repeats <= most[r.source] for r in out.itertuples())
    assert mx.mix(docs.limit(0), targets).count() == 0 and mx.mix(docs, targets.limit(0)).count() == 0
