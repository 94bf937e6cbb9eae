"""Every query on empty tables, on rows of nulls, on odd values, and with further columns of unlucky names."""

import pytest
from pyspark.sql import functions as F

from pagewright.llm import confusables, entity, mixing, splits, tokenizer, truncation
from pagewright.llm import queries as q

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
TABLES = {
    "kitap": "id string, klasoradi string, baslik string, sayfasayisi int, status int, kayit_zamani timestamp_ntz, silinme_zamani timestamp_ntz",
    "publisher_oge": "id string, kitapid string, ogeturu int, sayfano int, title string, data string, posx double, posy double, sayfaustuoge boolean, kayit_zamani timestamp_ntz",
    "sheets": "book_id string, page int, width double, height double, printed_page int, loaded_at timestamp_ntz, deleted_at timestamp_ntz",
    "activity": f"activity_key string, book_id string, page int, id string, label string, col_no int, rect {RECT}, kind string, headline string",
    "item": f"item_key long, activity_key string, id string, label string, number int, part_index int, rect {RECT}, text string",
    "spans": f"span_id long, book_id string, page int, ord int, text string, bbox {RECT}, font string, size double, flags int, color int",
    "book_score": "row_id long, book_id string, run_no int, split string, author_code string, series_code string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, book_id string, page int",
    "mix_targets": "source string, target_share double, max_repeats int",
    "split_targets": "split string, share double",
}
UNLUCKY = ("_h", "_k", "_n", "_key", "n", "e", "r", "u", "v", "at", "block", "near", "own", "running", "label_", "record", "vertex", "weight", "tail", "log_odds", "size", "prob", "extra", "form", "kinds", "_text", "_salt")


def put(spark, path, rows, extra=False):
    for name, schema in TABLES.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        if extra:
            df = df.withColumns({k: F.lit("x") for k in UNLUCKY if k not in df.columns})
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def nulls():
    return {name: [tuple([None] * len(schema.replace(RECT, "x").split(", ")))] * 3 for name, schema in TABLES.items()}


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_empty_tables_give_no_row(spark, tmp_path_factory, name):
    d = str(tmp_path_factory.getbasetemp() / "empty-tables")
    try:
        put(spark, d, {})
    except Exception:  # written by an earlier case
        pass
    assert q.QUERIES[name](spark, d).count() == 0


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_rows_of_nulls(spark, tmp_path_factory, name):
    d = str(tmp_path_factory.getbasetemp() / "null-rows")
    try:
        put(spark, d, nulls())
    except Exception:  # written by an earlier case
        pass
    n = q.QUERIES[name](spark, d).count()
    # a null document is a row with no ids and no size, of a null source; null targets are reported as they are
    assert n == {"p6_ids": 3, "p6_sizes": 1, "p7_shares": 3, "p8_rates": 1, "p4_shares": 3}.get(name, 0)


def odd():
    long = "Uzun bir cümle burada sürer ve sonunda biter. " * 20_000
    box = (60.0, 600.0, 500.0, 700.0)
    return {
        "kitap": [("k", "b", "t", 1, 1, None, None), (" {K} ", "B", "t", 1, 1, None, None)],
        "publisher_oge": [("o1", "k", 1, 5, "5/a", "x", 11.0, 12.5, True, None), ("o1", "{K}", 1, 5, "5/a", "x", 11.0, 12.5, True, None), ("o2", "k", 1, 0, long, "x", float("nan"), 0.0, True, None), ("o3", "k", 1, -4, "", "x", 0.0, 0.0, True, None), ("o4", "none", 1, 5, "5/b", "x", 1.0, 1.0, True, None)],
        "sheets": [("b", 1, 600.0, 800.0, 5, None, None), ("b", 1, 600.0, 800.0, 5, None, None), ("b", 2, None, None, None, None, None)],
        "activity": [("r1", "b", 1, "i", "a)", 0, box, "activity", None), ("r1", "b", 1, "i", "a)", 0, box, "activity", None), ("r2", "b", 2, "i", None, 0, None, "activity", long), ("r3", "b", 1, "i", "b", 0, box, None, None)],
        "spans": [(1, "b", 1, 0, "Ｓ" * 30_000, None, None, None, None, None), (2, "b", 1, 0, "", None, None, None, None, None), (3, "b", 1, 0, "düz", None, None, None, None, None), (4, "b", 1, 0, "́", None, None, None, None, None)],
        "item": [(7, "r1", "i", "а)", None, None, None, None)] * 2,
        "book_score": [(1, "b", 1, "Train ", "a1", None), (2, "c", 1, "test", " A1", "-"), (3, "d", 1, "test", "", "s"), (4, "d", 2, None, None, "s"), (4, "d", 2, None, None, "s")],
        "documents": [(1, long, "tr", "s", 1, None, None), (2, "", "tr", "s", 0, None, None), (3, None, None, "s", 0, None, None), (4, " \n\t ", "xx", None, 4, None, None), (5, "Kısa.", "tr", "t", 5, None, None), (6, "Kısa.", "tr", "t", 5, None, None)],
        "mix_targets": [("s", 0.5, 2), ("t", 0.5, 1), ("none", 0.0, 0), (None, 0.1, 1), ("neg", -1.0, None)],
        "split_targets": [("train", 0.8), ("test", 0.2), ("zero", 0.0), ("none", None)],
    }


@pytest.mark.parametrize("extra", [False, True])
def test_odd_values_and_further_columns(spark, tmp_path, extra):
    d = put(spark, tmp_path, odd(), extra)
    got = {name: f(spark, d).collect() for name, f in q.QUERIES.items()}
    assert [tuple(r) for r in got["p1_found"]] == [("o1", "r1")]
    assert {r.book_id for r in got["p4_found"]} == {"b", "c"} and {r.book_id for r in got["p4_splits"]} == {"b", "c", "d"}
    assert {(r.table_name, r.row_key) for r in got["p5_found"]} == {("spans", "1"), ("item", "7")}
    ids = {r.doc_id: list(r.ids) for r in got["p6_ids"]}
    assert len(ids) == 6 and ids[2] == ids[3] == [] and ids[5] == ids[6] and len(ids[1]) > 100_000
    mixed = {r.doc_id: r.repeats for r in got["p7_mix"]}
    assert set(mixed) <= {1, 5, 6} and all(mixed.get(k, 0) <= 1 for k in (5, 6)) and {r.source for r in got["p7_shares"]} == {"s", "t", "none", None, "neg"}
    assert {r.doc_id for r in got["p8_found"]} <= {1, 5, 6} and {r.source: r.n_docs for r in got["p8_rates"]} == {"s": 3, "t": 2, None: 1}


def test_operators_take_frames_with_unlucky_columns(spark):
    docs = spark.createDataFrame([(i, f"Bu {i}. cümle tamdır.", "tr", "s") for i in range(20)], "doc_id long, text string, lang string, source string").withColumns({k: F.lit("x") for k in UNLUCKY})
    assert truncation.judged(docs).count() == 20
    assert tokenizer.encoded(docs.select("doc_id", "text", "_h", "n")).count() == 20
    assert confusables.forms(docs, ["doc_id"], "text").count() == 0 and confusables.consistent_text(docs, "text").count() == 20
    edges = spark.createDataFrame([("a", "b")], "u string, v string").withColumns({k: F.lit("x") for k in ("turn", "parent", "_to")})
    assert splits.components(edges).count() == 2
    sizes = spark.createDataFrame([("g", 2)], "group string, weight long").withColumns({k: F.lit("x") for k in ("_size", "_h", "_middle", "running", "split")})
    assert splits.assign_splits(sizes, [("train", 1.0)]).first().split == "train"
    sample = spark.createDataFrame([(i, "s", 5, 0.5) for i in range(10)], "doc_id long, source string, size int, prob double").withColumns({k: F.lit("x") for k in ("block", "blocks", "extra")})
    assert sum(r.extra for r in mixing.cube_sample(sample).collect()) == 5
    pairs = spark.createDataFrame([("e", "r", 1.0)], "e string, r string, evidence double").withColumns({k: F.lit("x") for k in ("s", "rho", "alpha", "beta", "confidence", "was")})
    assert entity.marginals(pairs).count() == 1
