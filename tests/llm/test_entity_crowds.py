import pytest
from pyspark.sql import functions as F

from pagewright.llm import entity as en

E = "e string, book string, page int, title_page int, label string, name string, x double, y double"
R = "r string, book string, page int, label string, head string, left double, top double"


def pairs(spark, own, regions):
    return en.candidates(en.classes(spark.createDataFrame(own, E), "e"), en.classes(spark.createDataFrame(regions, R), "r"))


@pytest.mark.parametrize("n", [60, 70, 700])
def test_an_entry_without_place_keeps_all_candidates_of_a_crowd(spark, monkeypatch, n):
    monkeypatch.setattr(en, "HOT_ROWS", 2 if n == 700 else 200_000)
    own = [("label", "b", 1, 1, "a", None, None, None), ("name", "b", 1, 1, None, "x", None, None), ("far", "b", 1, 1, "a", None, 90.0, 90.0)]
    regions = [(f"r{i}", "b", 1, "a", "x", 5.0, i / 10) for i in range(n)]
    got = pairs(spark, own, regions).groupBy("e").agg(F.sum("n_r").alias("n")).collect()
    assert {r.e: r.n for r in got} == {"label": n, "name": n, "far": n}


def test_copies_are_one_class_with_their_number(spark):
    own = [(f"e{i}", "b", 1, 1, "a", None, None, None) for i in range(500)] + [("e", "b", 2, 2, "a", None, None, None)]
    regions = [(f"r{i}", "b", 1, "a", None, 5.0, 5.0) for i in range(400)] + [("r", "b", 2, "a", None, 5.0, 5.0)]
    got = pairs(spark, own, regions)
    assert sorted(tuple(r) for r in got.select("e", "r", "n_e", "n_r").collect()) == [("e", "r", 1, 1), ("e0", "r0", 500, 400)]
    m = {r.e: r.confidence for r in en.marginals(en.weighed(got)).collect()}
    assert m["e"] > 0.9 and m["e0"] < 0.01
    assert [r.e for r in en.one_to_one(en.marginals(en.weighed(got))).collect()] == ["e"]


def test_a_class_has_the_marginals_of_its_copies(spark):
    one = spark.createDataFrame([("a", "x", 2, 3, 1.5), ("a", "y", 2, 1, 0.5), ("b", "y", 1, 1, 2.0)], "e string, r string, n_e long, n_r long, evidence double")
    every = [(e, r, 1.5) for e in ("a1", "a2") for r in ("x1", "x2", "x3")] + [("a1", "y", 0.5), ("a2", "y", 0.5), ("b", "y", 2.0)]
    many = {(r.e, r.r): r.confidence for r in en.marginals(spark.createDataFrame(every, "e string, r string, evidence double"), 1e-6).collect()}
    got = {(r.e, r.r): r.confidence for r in en.marginals(one, 1e-6).collect()}
    assert got == {k: pytest.approx(many[m], abs=1e-4) for k, m in ((("a", "x"), ("a1", "x1")), (("a", "y"), ("a1", "y")), (("b", "y"), ("b", "y")))}
