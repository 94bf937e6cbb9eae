import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import ink, library

BOOKS = "id string, title string, grade int, grade_label string, installed boolean"


def books(spark):
    return spark.createDataFrame([("a", "Coğrafya", 9, "9. Sınıf", True), ("b", "Biyoloji", 10, "10. Sınıf", False), ("c", "Tarih", None, None, None), ("d", "Çevre", 9, "9. Sınıf", False), ("e", "Atlas", 7, "7", False)], BOOKS)


def test_search_sections_and_filters(spark):
    b = books(spark)
    assert {r.id for r in library.filtered(b, 9, "").collect()} == {"a", "d"} and {r.id for r in library.filtered(b, "installed", "COGRAFYA").collect()} == {"a"} and library.filtered(b, "all", "10. sınıf").first().id == "b"
    assert {r.id for r in library.only(b, ["TAR", "atl"], ["id", "title"]).collect()} == {"c", "e"} and library.only(b, [], ["id"]).count() == 5
    assert [(r.section, r.number, r.id) for r in library.sections(b).orderBy("place", "number").collect()] == [("installed", 1, "a"), ("9", 1, "d"), ("10", 1, "b"), ("0", 1, "e"), ("0", 2, "c")]


def test_changes_and_enrichment(spark):
    now = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("n", 1, "x")], "id string, v int, w string")
    old = spark.createDataFrame([("a", 1, None), ("b", 3, "x"), ("o", 1, "x")], "id string, v int, w string")
    assert {r.id: r.change for r in library.changes(now, old, "id").collect()} == {"a": "same", "b": "changed", "n": "added", "o": "removed"}
    e = library.enriched(books(spark).drop("installed"), spark.createDataFrame([("a",), ("a",)], "id string"), spark.createDataFrame([("a", 5), ("a", 7)], "id string, size long"), spark.createDataFrame([("b", "strong")], "id string, confidence string"),
                         spark.createDataFrame([("b", 1, "queued"), ("b", 2, "running")], "id string, seq int, state string"))
    got = {r.id: (r.installed, r.size, r.confidence, r.download) for r in e.collect()}
    assert got["a"] == (True, 7, "none", None) and got["b"] == (False, None, "strong", "running") and len(got) == 5
    assert {r.id: r.download for r in library.status_pushed(e, spark.createDataFrame([("c", "done")], "id string, state string")).collect()} == {"a": None, "b": None, "c": "done", "d": None, "e": None}


def test_recents_and_entries(spark):
    o = spark.createDataFrame([("u", f"b{i % 12}", i) for i in range(30)], "user string, id string, at int")
    rec = library.recents(o, "user", "id", "at")
    assert [r.id for r in rec.orderBy("place").collect()] == [f"b{i % 12}" for i in range(29, 21, -1)]
    here = spark.createDataFrame([("b5", True), ("b4", False), ("b3", True)], "id string, ok boolean")
    assert [(r.id, r.place) for r in library.openable(rec.drop("at"), here, F.col("ok")).orderBy("place").collect()] == [("b5", 1), ("b3", 2)]
    m = spark.createDataFrame([("a", 0, "e"), ("a", 1, "f"), ("z", 0, "g")], "book_id string, ord int, id string")
    own, unknown = library.entries_of(m, books(spark), spark.createDataFrame([("a",), ("b",), ("z",)], "id string"))
    assert {r.id for r in own.collect()} == {"e", "f"} and [r.id for r in unknown.collect()] == ["z"]
    assert library.by_id(spark.createDataFrame([("e", 0, 1), ("e", 1, 2)], "id string, ord int, v int")).first().v == 2


def test_summaries_paths_and_work(spark):
    r = spark.createDataFrame([("b", 2, 0, "x", "a)", None, "activity"), ("b", 2, 1, "y", None, "Uzun  başlık " * 20, "activity"), ("b", 2, 2, "z", " ", "", "activity"), ("b", 10, 0, "c", "a", None, "content")],
                              "book_id string, page int, ord int, id string, label string, headline string, kind string")
    got = {x.id: x for x in library.summaries(r, spark.createDataFrame([("x", "e2"), ("x", "e1")], "id string, entry string"), spark.createDataFrame([("x", 0), ("x", 1), ("x", 1)], "id string, part_index int")).collect()}
    assert (got["x"].name, got["x"].entry, got["x"].n_items, got["x"].n_parts) == ("a", "e1", 3, 2) and len(got["y"].name) == 140 and got["y"].name.endswith("…") and got["z"].name == "#3" and "c" not in got
    assert [x.page for x in library.pages_with_activities(r.withColumn("page", F.col("page").cast("string"))).collect()] == [2, 10]
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    p = library.resolved_path([("bundle", spark.createDataFrame([("a", "/1")], "id string, path string")), ("legacy", spark.createDataFrame([("a", "/2"), ("b", "/3")], "id string, path string"))], ids)
    assert {x.id: (x.kind, x.path) for x in p.collect()} == {"a": ("bundle", "/1"), "b": ("legacy", "/3"), "c": (None, None)}
    wanted = spark.createDataFrame([("a", "f1", None), ("b", "f1", None), ("c", "f1", "p")], "id string, fingerprint string, profile string")
    done = spark.createDataFrame([("a", "f1", None), ("b", "f0", None)], "id string, fingerprint string, profile string")
    assert {x.id for x in library.needs_work(wanted, done, ["fingerprint", "profile"]).collect()} == {"b", "c"}
    pg = spark.createDataFrame([("a", 1, 600.0, 800.0, 2), ("b", 1, 600.0, 800.0, 2)], "book_id string, page int, width double, height double, page_count int")
    bk = spark.createDataFrame([("a", 1, 600.5, 800.0, 2), ("b", 1, 602.0, 800.0, 2)], "book_id string, page int, width double, height double, page_count int")
    assert {x.book_id: x.fits for x in library.same_edition(pg, bk).collect()} == {"a": True, "b": False}


def recursive(p, tol):
    """Simplification as it is usually defined."""
    if len(p) < 3:
        return p.tolist()
    far = ink.distance(p[1:-1], p[0], p[-1])
    k = int(far.argmax())
    if far[k] <= tol:
        return [p[0].tolist(), p[-1].tolist()]
    return recursive(p[:k + 2], tol)[:-1] + recursive(p[k + 1:], tol)


def test_simplification_and_erasing():
    rng = np.random.default_rng(4)
    for _ in range(30):
        p = np.cumsum(rng.normal(0, 2, (40, 2)), axis=0)
        assert ink.simplify(p, 1.5).tolist() == recursive(p, 1.5)
    line = np.array([[float(i), 0.0] for i in range(11)])
    assert [r[:, 0].tolist() for r in ink.erase(line, np.array([5.0, -1.0]), np.array([5.0, 1.0]), 0.6)] == [[0, 1, 2, 3, 4], [6, 7, 8, 9, 10]]
    assert len(ink.erase(line, np.array([5.0, 50.0]), np.array([6.0, 50.0]), 1.0)[0]) == 11 and ink.erase(line, np.array([0.0, 0.0]), np.array([10.0, 0.0]), 1.0) == []
    a, b = np.array([0.0, 0.0]), np.array([2.0, 2.0])
    assert ink.crosses(a, b, np.array([0.0, 2.0]), np.array([2.0, 0.0])) and not ink.crosses(a, b, np.array([3.0, 3.0]), np.array([4.0, 4.0])) and ink.segment_distance(a, b, np.array([3.0, 2.0]), np.array([4.0, 2.0])) == pytest.approx(1.0)


def test_strokes_in_frames(spark):
    s = spark.createDataFrame([("s", 1, [float(x) for i in range(11) for x in (i, 0)], 2.0), ("t", 1, [50.0, 50.0, 60.0, 60.0], 1.0), ("bad", 1, [1.0], 1.0), ("none", 1, None, 1.0)], "id string, page int, points array<double>, width double")
    assert {r.id for r in ink.valid(s).collect()} == {"s", "t"}
    got = sorted((r.id, r.run, len(r.points)) for r in ink.erased(ink.valid(s), (5.0, -1.0), (5.0, 1.0), 0.6).collect())
    assert got == [("s", 0, 10), ("s", 1, 10), ("t", 0, 4)]
    box = {r.id: r.o for r in s.select("id", ink.outline(F.col("points"), F.col("width")).alias("o")).collect()}
    assert tuple(box["s"]) == (-1.0, -1.0, 11.0, 1.0) and box["none"] is None
    assert {r.id: r.p for r in s.select("id", ink.simplified(F.col("points"), 0.5).alias("p")).collect()}["s"] == [0.0, 0.0, 10.0, 0.0]


def test_stroke_store_and_budget(spark):
    ev = spark.createDataFrame([(1, "add", 1, "a", 10), (2, "add", 1, "b", 20), (3, "remove", 1, "a", None), (4, "restore", 1, "a", None), (5, "add", 2, "c", 5), (6, "clear", 2, None, None), (7, "add", 2, "d", 7), (8, "remove", 1, "b", None)], "seq int, op string, page int, id string, size int")
    assert {r.id: r["size"] for r in ink.store(ev).collect()} == {"a": 10, "d": 7}
    assert {r.page: r.version for r in ink.page_versions(ev).collect()} == {1: 5, 2: 3}
    assert {r.id: r.net for r in ink.net_changes(ev.where("op <> 'clear'").withColumn("s", F.lit(1)), ["s"]).collect()} == {"a": 1, "c": 1, "d": 1}
    st = spark.createDataFrame([("u", f"s{i}", i, 10) for i in range(6)], "u string, id string, created_ms long, size int")
    assert {r.id for r in ink.within_budget(st, ["u"], "size", 30).collect()} == {"s3", "s4", "s5"}
    assert {r.id for r in ink.within_budget(st, ["u"], "size", 30, st.where("id = 's0'")).collect()} == {"s0", "s4", "s5"}
