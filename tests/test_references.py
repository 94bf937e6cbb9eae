from datetime import datetime

from pagewright.operators import references as ref
from pagewright.operators.skew import hot_keys, salted_join


def t(day):
    return datetime(2024, 1, day)


def test_orphans_at_the_time_of_the_row(spark):
    parents = spark.createDataFrame([("a", t(2), None), ("b", t(2), t(5)), ("b", t(8), None), (None, t(1), None), ("c", None, None)], "k string, came timestamp_ntz, gone timestamp_ntz")
    refs = spark.createDataFrame([(1, "a", t(1)), (2, "a", t(2)), (3, "b", t(5)), (4, "b", t(4)), (5, "b", t(9)), (6, "z", t(9)), (7, None, t(9)), (8, "c", t(9)), (6, "z", t(9))], "id int, k string, at timestamp_ntz")
    rows = ref.orphan_rows(refs, ref.presence(parents, ["k"], "came", "gone"), ["k"], "at")
    assert {r.id for r in rows.where("orphan").collect()} == {1, 3, 6, 8}
    assert rows.count() == 8  # the null reference is none; the repeated row stays


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, came timestamp_ntz, gone timestamp_ntz")
    refs = spark.createDataFrame([(1, "a", t(1))], "id int, k string, at timestamp_ntz")
    assert ref.orphans(refs, ref.presence(none, ["k"], "came", "gone"), ["k"], "at").count() == 1
    assert ref.orphans(refs.limit(0), ref.presence(none, ["k"], "came", "gone"), ["k"], "at").count() == 0


def test_salted_join_equals_plain_join(spark):
    left = spark.range(4000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 50)) as k").unionByName(spark.createDataFrame([(-1, None)], "id long, k string"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3), ("zz", 4), (None, 5)], "k string, v int")
    hot = hot_keys(left.where("k is not null"), ["k"], hot_share=0.05, hot_rows=100)
    assert [h[0] for h in hot] == ["hot"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = salted_join(left, right, ["k"], how, hot_share=0.05, hot_rows=100)
        want = left.join(right, "k", how).select(got.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), how
