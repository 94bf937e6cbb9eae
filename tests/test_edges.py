"""The general problems' queries on empty tables, on rows of nulls, and with further columns of unlucky names."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import intervals, references
from pagewright.operators.prefix import numbered, running_sum
from pagewright.operators.skew import salted_join
from pagewright.plans import problems

TABLES = {
    "kitap": "id string, klasoradi string, kayit_zamani timestamp_ntz, silinme_zamani timestamp_ntz",
    "kitapunite": "id string, kitapid string, uniteid string, baslangicsayfasi int, bitissayfasi int, guncelleme_zamani timestamp_ntz",
    "publisher_oge": "id string, kitapid string, sayfano int, kayit_zamani timestamp_ntz",
    "sheets": "book_id string, page int, printed_page int, loaded_at timestamp_ntz, deleted_at timestamp_ntz",
}


def put(spark, path, rows, extra=()):
    for name, schema in TABLES.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        df.withColumns({c: F.lit("x") for c in extra if c not in df.columns}).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_empty_and_null_tables_give_no_row(spark, tmp_path, name):
    d = put(spark, tmp_path / "empty", {})
    assert problems.QUERIES[name](spark, d).count() == 0
    d = put(spark, tmp_path / "nulls", {t: [tuple([None] * len(s.split(", ")))] * 3 for t, s in TABLES.items()})
    assert problems.QUERIES[name](spark, d).count() == 0


def test_further_columns_and_repeated_rows(spark, tmp_path):
    from datetime import datetime as t

    one, two = t(2024, 1, 1), t(2024, 2, 1)
    rows = {"kitap": [("k", "b", one, None)] * 2, "sheets": [("B", 1, 5, one, two)] * 2, "publisher_oge": [("o", " {K}", 5, one), ("o", "k", 5, two), ("p", "k", 5, two), ("q", "z", 5, one), ("r", "k", 0, one)],
            "kitapunite": [("u", "k", "a", 1, 5, one), ("u", "k", "a", 1, 7, two), ("v", "K", "b", 7, 9, one), ("w", "k", None, 12, 12, one), ("x", "k", "c", 9, 3, one), ("y", "z", None, 1, 2, one)]}
    d = put(spark, tmp_path, rows, ("_i", "i", "at", "kid", "orphan", "folder", "_entity", "_s", "_e", "_own", "prev_end", "island_start", "first_page", "last_page", "kind", "v", "t"))
    assert {tuple(r) for r in problems.QUERIES["p2_found"](spark, d).collect()} == {("publisher_oge", "p", "sayfano"), ("publisher_oge", "q", "kitapid"), ("kitapunite", "y", "kitapid")}
    assert {tuple(r) for r in problems.QUERIES["p3_found"](spark, d).collect()} == {("k", "period", 1, 9), ("k", "period", 12, 12), ("k", "gap", 10, 11), ("k", "overlap", 7, 7), ("z", "period", 1, 2)}


def test_operators_take_frames_with_unlucky_columns(spark):
    df = spark.createDataFrame([("a", 1, 4), ("a", 3, 6), (None, 1, 2), (None, 2, 3)], "e string, s int, t int").withColumns({c: F.lit("x") for c in ("_entity", "_s", "_e", "_own", "prev_end", "prev_owned", "island_start")})
    assert {(r.e, r.island_start) for r in intervals.islands(df, ["e"], "s", "t").collect()} == {("a", 1), (None, 1)}
    n = spark.createDataFrame([("a", i) for i in range(9)], "k string, v int").withColumns({c: F.lit("x") for c in ("_one", "_upto", "_start", "_w_running", "number", "running")})
    assert sorted(r.number for r in numbered(n, ["k"], ["v"]).collect()) == list(range(1, 10)) and max(r.running for r in running_sum(n, ["v"], "v").collect()) == 36
    refs = spark.createDataFrame([("k", 1), ("z", 1), (None, 1)], "key string, at int").withColumns({c: F.lit("x") for c in ("orphan", "_came", "_gone")})
    there = spark.createDataFrame([("k", 0, 9)], "key string, _came int, _gone int")
    assert {(r.key, r.orphan) for r in references.orphan_rows(refs, there, ["key"], "at").collect()} == {("k", False), ("z", True)}
    untimed = spark.createDataFrame([("z", None)], "key string, at int")
    assert [(r.key, r.orphan) for r in references.orphan_rows(untimed, there, ["key"], "at").collect()] == [("z", False)]
    left = spark.createDataFrame([("k", i) for i in range(50)] + [(None, 1)], "k string, v int").withColumns({c: F.lit("x") for c in ("_h0", "_n")})
    assert salted_join(left, spark.createDataFrame([("k", 1)], "k string, w int"), ["k"], hot_share=0.1, hot_rows=10).count() == 50
