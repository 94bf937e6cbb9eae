import itertools
import math

import pytest
from pyspark.sql import functions as F

from pagewright.llm import entity as en


def exact(pairs):
    """Marginals of all matchings by enumeration."""
    total, weight = 0.0, {p[:2]: 0.0 for p in pairs}
    for k in range(len(pairs) + 1):
        for chosen in itertools.combinations(pairs, k):
            if len({c[0] for c in chosen}) == k == len({c[1] for c in chosen}):
                w = math.exp(sum(c[2] for c in chosen))
                total += w
                for c in chosen:
                    weight[c[:2]] += w
    return {k: v / total for k, v in weight.items()}


def test_marginals_on_a_tree_are_exact(spark):
    pairs = [("a", "x", 2.0), ("a", "y", 1.0), ("b", "y", 3.0), ("c", "z", -1.0)]
    got = {(r.e, r.r): r.confidence for r in en.marginals(spark.createDataFrame(pairs, "e string, r string, evidence double"), 1e-7).collect()}
    assert got == {k: pytest.approx(v, abs=1e-5) for k, v in exact(pairs).items()}


def test_loops_and_ties_stay_one_to_one(spark):
    pairs = [(e, r, 4.0 if e == r else 1.0) for e in "abc" for r in "abc"] + [("p", "q", 1.0), ("o", "q", 1.0)]
    got = en.one_to_one(en.marginals(spark.createDataFrame(pairs, "e string, r string, evidence double"))).collect()
    assert {(r.e, r.r) for r in got} == {("a", "a"), ("b", "b"), ("c", "c")}
    assert en.marginals(spark.createDataFrame([], "e string, r string, evidence double")).count() == 0


@pytest.mark.parametrize("title,want", [("30. sayfa 16. soru", (30, "16", None)), ("S59_52_Kum Saati", (59, "52", "kum saati")), ("48/a-ed2", (48, "a", None)), ("Kum Saati (12/l)", (12, "l", "kum saati")),
                                        ("29 (4)", (4, "29", None)), ("23- d) Kum Saati", (23, "d", "kum saati")), ("Kum Saati çalışması", (None, None, "kum saati")), (None, (None, None, None))])
def test_titles(spark, title, want):
    df = spark.createDataFrame([(title,)], "title string").withColumn("p", en.parsed(en.fold("title")))
    assert tuple(df.select(F.col("p.*")).first()) == want
