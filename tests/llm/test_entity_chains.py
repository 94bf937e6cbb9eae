import math

import pytest

from pagewright.llm import entity as en

N, W = 91, math.exp(9.0)


def test_long_chains_are_run_to_the_end(spark):
    # Pair i of the chain shares an entity with pairs i - 1 and i + 1; z[k] sums over all matchings of k pairs in a row.
    z = [1.0, 1.0 + W]
    for _ in range(N):
        z.append(z[-1] + W * z[-2])
    exact = [W * z[max(i - 1, 0)] * z[max(N - i - 2, 0)] / z[N] for i in range(N)]
    pairs = [(f"e{(i + 1) // 2}", f"r{i // 2}", 9.0) for i in range(N)]
    df = spark.createDataFrame(pairs, "e string, r string, evidence double").coalesce(1)
    got = {(r.e, r.r): r.confidence for r in en.marginals(df).collect()}
    assert [got[p[:2]] for p in pairs] == pytest.approx(exact, abs=0.01)
    with pytest.raises(RuntimeError):
        en.marginals(df, most=3)
