import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import files
from pagewright.operators import book, fitting


def test_runs_of_sheets():
    assert book.contents_run([4], [5, 7, 12]) == [4, 5, 7] and book.contents_run([], [5]) == []
    assert book.back_start({90, 91}, {92, 93, 94, 95}, 95) == 90 and book.back_start(set(), set(), 10) == 11 and book.back_start({20}, set(), 95) == 96
    assert book.back_start(set(), set(range(50, 96)), 95) == 96 and book.back_start({85}, {95}, 95) == 85
    assert book.front_end([8, 30], [4, 5], None, 200, None) == 7 and book.front_end([], [4], 6, 200, None) == 5 and book.front_end([], [], None, 200, None) == 0 and book.front_end([8], [4], None, 200, 3) == 2
    assert book.first_activity([3, 9, 11, 12]) == 9 and book.first_activity([3]) is None


def test_kinds_of_sheets(spark):
    def page(p, texts, size=10.0, font="f"):
        return [("b", p, i, t, (50.0, 760.0 - 20 * i, 500.0, 770.0 - 20 * i), font, size, 0) for i, t in enumerate(texts)]

    rows = page(1, ["İçindekiler", "1. ÜNİTE Kuvvet ...... 12", *[f"Konu {i} ........ {i + 12}" for i in range(9)]]) + page(2, [f"Konu {i}  .......  {i}" for i in range(10)]) + page(3, ["1. ÜNİTE"], 48.0)
    rows += page(4, ["PERFORMANS GÖREVİ", "Yönerge burada yazar ve uzunca bir satırdır."]) + page(5, ["Kaynakça"]) + page(6, [f"Soyad{i}, A. (20{i}). Başlık" for i in range(10, 20)]) + page(7, ["Bu bir konu sayfasıdır ve kırktan çok harf taşıyan satırlar vardır."] * 8)
    spans = spark.createDataFrame(rows, "book_id string, page int, ord int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, font string, size double, flags int")
    sheets = spark.createDataFrame([("b", p, 600.0, 800.0) for p in range(1, 10)], "book_id string, page int, width double, height double")
    grounds = spark.createDataFrame([("b", 9, (0.0, 0.0, 600.0, 500.0)), ("b", 7, (0.0, 0.0, 600.0, 800.0))], "book_id string, page int, rect struct<x0:double,y0:double,x1:double,y1:double>")
    body = spark.createDataFrame([("b", p, 10.0) for p in range(1, 10)], "book_id string, page int, body_size double")
    kinds = book.page_kinds(sheets, book.page_rows(spans), grounds, body)
    got = {r.page: r for r in kinds.collect()}
    assert [got[p].contents for p in (1, 2, 3)] == ["named", "listed", None] and got[1].first_chapter == 12
    assert [p for p in got if got[p].opener] == [3] and got[4].form == "PERFORMANS GÖREVİ" and {p for p in got if got[p].bibliography} == {5, 6} and {p for p in got if got[p].plate} == {8, 9}
    printed = sheets.select("book_id", "page", (F.col("page") + 9).alias("printed"))
    acts = spark.createDataFrame([("b", 4), ("b", 7)], "book_id string, page int")
    m = book.matter(kinds, printed, acts).first()
    assert (m.pages, m.contents, m.front_matter_end, m.back_matter_start, m.first_activity) == (9, [1, 2], 2, 5, 4.0)


def test_folio_candidates(spark):
    rows = [("b", 1, 0, "12", (20.0, 20.0, 30.0, 30.0)), ("b", 1, 1, "7", (300.0, 780.0, 310.0, 790.0)), ("b", 2, 0, "Metin", (20.0, 20.0, 30.0, 30.0)), ("b", 3, 0, "9", (290.0, 780.0, 310.0, 790.0)), ("b", 3, 1, "5", (20.0, 780.0, 30.0, 790.0))]
    spans = spark.createDataFrame(rows, "book_id string, page int, ord int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    sheets = spark.createDataFrame([("b", p, 600.0, 800.0) for p in (1, 2, 3)], "book_id string, page int, width double, height double")
    assert {r.page: r.folio for r in book.folio_candidates(spans, sheets).collect()} == {1: 12, 3: 5}


def bowl(trials):
    return [(t["PAD"] - 5) ** 2 + 0.01 * (t["FLOW"] - 120) ** 2 for t in trials]


def test_settings():
    p = fitting.profile({"PAD": 3.0})
    assert p["PAD"] == 3.0 and p["FLOW"] == 90.0 and fitting.changed(p) == {"PAD": 3.0}
    with pytest.raises(ValueError):
        fitting.profile({"PAD": 99.0})
    with pytest.raises(ValueError):
        fitting.profile({"NONE": 1.0})
    assert fitting.profile({"PAD": 99.0, "NONE": 1.0}, strict=False)["PAD"] == 16.0
    k = fitting.KNOBS[4]
    assert k.decode(k.encode(7)) == 7 and k.decode(2.0) == k.high
    assert files.profile_hash({"a": 1, "b": 2}) == files.profile_hash({"b": 2, "a": 1}) and len(files.profile_hash({})) == 12


def test_searches_find_the_bottom():
    assert [n for n, _ in fitting.screen(bowl)] == ["PAD", "FLOW"]
    best, least = fitting.coordinate_descent(bowl, ["FLOW", "PAD"])
    assert least < bowl([fitting.profile({})])[0] and abs(best["PAD"] - 5) < 1.5
    assert fitting.coordinate_descent(bowl, ["FLOW"], allowed=lambda t: False)[0] == fitting.profile({})
    best, least = fitting.evolve(bowl, ["FLOW", "PAD"], budget=300)
    assert least < 0.05


def test_logistic_model_separates(spark):
    rng = np.random.default_rng(2)
    rows = [([float(a), float(b)], bool(a + 0.5 * b > 0.3)) for a, b in rng.normal(0, 1, (400, 2))]
    df = spark.createDataFrame([*rows, (None, True)], "features array<double>, y boolean")
    w = fitting.train_logistic(df, rounds=60)
    out = fitting.scored(df.where("features is not null"), w).collect()
    assert sum((r.p > 0.5) == r.y for r in out) / len(out) > 0.93
    assert len(fitting.train_logistic(df.where("y"), rounds=2)) == 3 and fitting.train_logistic(df.limit(0)) == [0.0]
    assert fitting.scored(df.limit(1), [800.0, 0.0, 0.0]).first().p == 1.0 and fitting.scored(df.limit(1), [-800.0, 0.0, 0.0]).first().p == 0.0
