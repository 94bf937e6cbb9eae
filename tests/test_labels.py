import pytest
from pyspark.sql import functions as F

from pagewright.operators import detection, labels, scoring

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
SHEET = "book_id string, page int, width double, height double"


@pytest.mark.parametrize("given,ok,repeats", [(["a", "b)", "c."], True, 0), (["b", "c"], True, 0), (["a", "c"], False, 0), (["1", "2", "2."], True, 1), (["1", "3"], False, 0), (["a", "metin"], False, 0), ([], True, 0), ([None, " "], True, 0), (["a", "ç", "b"], True, 0)])
def test_label_runs(spark, given, ok, repeats):
    run, n = labels.run_ok(F.col("l"))
    assert tuple(spark.createDataFrame([(given,)], "l array<string>").select(run, n).first()) == (ok, repeats)


def pages(spark, n=4):
    return spark.createDataFrame([("b", p, 600.0, 800.0) for p in range(1, n + 1)], SHEET)


def test_pages_are_judged(spark):
    boxes = spark.createDataFrame([("b", 1, "x", "a", (100.0, 100.0, 300.0, 200.0)), ("b", 2, "x", "a", (0.0, 0.0, 4.0, 50.0)), ("b", 2, "y", "b", (100.0, 100.0, 300.0, 200.0)), ("b", 2, "z", None, (250.0, 150.0, 400.0, 300.0)),
                                   ("b", 3, "x", "a", (100.0, 100.0, 300.0, 200.0)), ("b", 3, "y", "c", (297.0, 100.0, 400.0, 200.0))], f"book_id string, page int, ord string, label string, rect {RECT}")
    icons = spark.createDataFrame([("b", 1, "near", 90.0, 210.0), ("b", 3, "far", 500.0, 700.0), ("b", 4, "none", 10.0, 10.0)], "book_id string, page int, id string, x double, y double")
    blocks = spark.createDataFrame([("b", 1, "solution", "s", (280.0, 120.0, 340.0, 180.0)), ("b", 1, "panel", "p", (250.0, 50.0, 350.0, 150.0)), ("b", 1, "marker", "m", (260.0, 60.0, 270.0, 70.0)), ("b", 1, "marker", "n", (260.0, 90.0, 270.0, 99.0)),
                                    ("b", 1, "solution", "off", (280.0, -50.0, 340.0, 180.0))], f"book_id string, page int, kind string, ord string, rect {RECT}")
    got = {r.page: r for r in labels.judged(pages(spark), boxes, icons, blocks).collect()}
    assert (got[1].cut, got[1].icons, got[1].miss, got[1].defects, got[1].passes) == (1, 1, 0, [], True)
    assert (got[2].sliver, got[2].overlap_major, got[2].defects) == (1, 1, ["sliver", "overlap"])
    assert (got[3].overlap_minor, got[3].overlap_major, got[3].miss, got[3].labels_ok, got[3].defects) == (1, 0, 1, False, ["miss"])
    assert (got[4].boxes, got[4].miss, got[4].labels) == (0, 1, [])
    assert {r.page for r in labels.judged(pages(spark), boxes, icons, blocks, miss_is_defect=False).where("passes").collect()} == {1, 3, 4}


def test_verdicts(spark):
    keyed, bare = "book_id string, page int, passes boolean", "book_id string, page int"
    p = spark.createDataFrame([("b", 1, True), ("b", 2, False), ("b", 3, False), ("b", 4, False)], keyed)
    again = spark.createDataFrame([("b", 2, True), ("b", 3, False), ("b", 9, True)], keyed)
    got = {r.page: (r.verdict, r.source, r.request_failed) for r in labels.resolved(p, spark.createDataFrame([("b", 5), ("b", 6)], bare), again, spark.createDataFrame([("b", 6)], bare)).collect()}
    assert got == {1: ("trusted", "primary", False), 2: ("trusted", "reask", False), 3: ("rejected", "reask", False), 4: ("re-ask", "primary", False), 5: ("re-ask", "primary", True), 6: ("rejected", "reask", True)}


def test_summary_and_reask_list(spark):
    v = spark.createDataFrame([("b", 2, "re-ask", ["sliver", "miss"], 2, 0, 1, 0, 0, 0, 1, 3, True), ("b", 1, "trusted", [], 0, 0, 0, 0, 0, 0, 0, 0, False)],
                              "book_id string, page int, verdict string, defects array<string>, boxes int, cut int, sliver int, tall int, overlap_major int, overlap_minor int, miss int, icons int, labels_ok boolean")
    assert [(r.page, r.why) for r in labels.reask_list(v).first().pages] == [(2, "sliver,miss")]
    total = labels.summary(v).where("book_id is null").first()
    assert (total.pages, total.trusted, total.re_ask, total.rejected, total.empty, total.labels_bad, total.boxes) == (2, 1, 1, 0, 1, 1, 2)


def test_training_set(spark):
    books = spark.createDataFrame([("a", "t", False, True), ("b", "t", False, True), ("c", "t", True, True), ("d", None, False, True)], "book_id string, template string, held_out boolean, labelled boolean")
    split = {r.book_id: r.split for r in labels.split_books(books).collect()}
    assert split["c"] == "heldout" and split["d"] == "train" and {split["a"], split["b"]} == {"train", "valid"}
    lab = spark.createDataFrame([("a", 1, 100, 100, [[-5.0, 90.0, 50.0, 20.0]]), ("a", 2, 100, 100, None), ("d", 1, 100, 100, [[1.0, 1.0, 2.5, 50.0]]), ("x", 1, 100, 100, []), ("d", 2, 100, 100, [])],
                                "book_id string, page int, width_px int, height_px int, boxes array<array<double>>")
    seen = spark.createDataFrame([("a", 1), ("a", 2), ("d", 1), ("x", 1)], "book_id string, page int")
    images, notes, dropped = labels.coco(lab, labels.split_books(books), seen)
    assert [(r.id, r.page) for r in images.orderBy("page").collect()] == [(0, 1), (1, 2)]
    assert [(r.id, r.image_id, r.bbox, r.area) for r in notes.collect()] == [(0, 0, [0.0, 20.0, 50.0, 70.0], 3500.0)]
    assert {(r.book_id, r.page): r.why for r in dropped.collect()} == {("d", 1): "a box of 2 px or less", ("x", 1): "book not in the selection", ("d", 2): "no rendered page"}
    with pytest.raises(Exception, match="held-out book"):
        labels.trainable(books, books.where("held_out"))


def test_doubtful_boxes_and_bands(spark):
    box, icon = f"book_id string, page int, ord int, score double, rect {RECT}", "book_id string, page int, id string, x double, y double"
    sure = spark.createDataFrame([("b", 1, 0, 0.9, (100.0, 100.0, 200.0, 200.0))], box)
    maybe = spark.createDataFrame([("b", 1, 1, 0.4, (300.0, 100.0, 400.0, 200.0)), ("b", 1, 2, 0.3, (310.0, 90.0, 400.0, 200.0)), ("b", 1, 3, 0.9, (300.0, 10.0, 500.0, 790.0)), ("b", 1, 4, 0.2, (300.0, 185.0, 400.0, 420.0))], box)
    icons = spark.createDataFrame([("b", 1, "held", 95.0, 195.0), ("b", 1, "free", 295.0, 195.0)], icon)
    assert [r.ord for r in labels.admitted(sure, maybe, icons, pages(spark, 1)).collect()] == [1]
    bands = spark.createDataFrame([("b", 1, 0, "wide", 0.0, 600.0, 50.0, 300.0), ("b", 1, 1, "tight", 250.0, 350.0, 150.0, 200.0)], "book_id string, page int, ord int, owner string, x0 double, x1 double, bottom double, top double")
    assert {r.id: r.owner for r in labels.band_owner(icons, bands).collect()} == {"held": "wide", "free": "tight"}


def test_scores_of_pages_without_truth_or_prediction(spark):
    pg = spark.createDataFrame([("b", 1), ("b", 2), ("c", 1)], "book_id string, page int")
    b = "book_id string, page int, ord int, x0 double, y0 double, x1 double, y1 double"
    truth = spark.createDataFrame([("b", 1, 0, 0.0, 0.0, 10.0, 10.0), ("b", 1, 1, 50.0, 0.0, 60.0, 10.0)], b)
    pred = spark.createDataFrame([("b", 1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), ("b", 2, 0, 0.0, 0.0, 10.0, 10.0, 0.8), ("b", 1, 1, 50.0, 0.0, 60.0, 10.0, 0.1)], b + ", score double")
    got = {r.scope: r for r in detection.scores(pg, pred, truth, 0.5).collect()}
    assert (got["b"].pages, got["b"].predicted_boxes, got["b"].precision, got["b"].recall, got["b"].empty_pages_with_a_box) == (2, 2, 0.5, 0.5, 1)
    assert got["b"].map50 == pytest.approx((51 + 50 * 2 / 3) / 101, abs=1e-4) == got["total"].map50
    assert (got["c"].map50, got["c"].precision, got["c"].recall, got["c"].empty_pages) == (None, None, None, 1)


def tallies(spark, anchored=False):
    regions = spark.createDataFrame([("b", 1, "r", 0, anchored, False), ("b", 2, "s", 3, False, True)], "book_id string, page int, id string, n_items int, anchored boolean, bound boolean")
    parts = spark.createDataFrame([("b", 1, "r0", anchored, (100.0, 100.0, 300.0, 200.0)), ("b", 1, "r1", False, (290.0, 100.0, 400.0, 200.0)), ("b", 2, "s0", False, (0.0, 10.0, 500.0, 700.0))], f"book_id string, page int, ord string, anchored boolean, rect {RECT}")
    blocks = spark.createDataFrame([("b", 1, "solution", "s", (380.0, 120.0, 440.0, 180.0)), ("b", 1, "marker", "m", (110.0, 110.0, 120.0, 120.0)), ("b", 3, "solution", "off", (-20.0, 0.0, 10.0, 10.0))], f"book_id string, page int, kind string, ord string, rect {RECT}")
    entries = spark.createDataFrame([("b", 1), ("b", 3)], "book_id string, page int")
    return scoring.page_tallies(pages(spark, 3), regions, parts, blocks, entries)


def test_tallies_merge_in_any_slices(spark):
    t = tallies(spark, anchored=True)
    whole = scoring.merged(t).first().asDict()
    assert {k: whole[k] for k in ("pages", "regions", "parts", "questions", "empty_regions", "pages_with_regions", "overlaps", "overlaps_anchored", "tall", "solutions_cut", "markers_in_region", "off_sheet_solutions", "oges_seen", "oges_on_blank_pages", "anchored")} == {
        "pages": 3, "regions": 2, "parts": 3, "questions": 3, "empty_regions": 1, "pages_with_regions": 2, "overlaps": 1, "overlaps_anchored": 1, "tall": 1, "solutions_cut": 1, "markers_in_region": 1, "off_sheet_solutions": 1, "oges_seen": 2,
        "oges_on_blank_pages": 1, "anchored": 1}
    slices = [scoring.merged(t.where(c)) for c in ("page = 1", "page > 1")]
    again = slices[0].unionByName(slices[1]).groupBy("book_id").agg(*[F.sum(c).alias(c) for c in whole if c != "book_id"])
    assert again.first().asDict() == whole


def test_first_claim_rows_marks_and_guards(spark):
    filed = spark.createDataFrame([("b", "e", 2, "ok"), ("b", "e", 1, "drift"), ("b", "f", 1, "ok")], "book_id string, entry_ord string, page int, bucket string")
    claimed = scoring.claims(filed)
    assert {r.entry_ord: r.bucket for r in claimed.collect()} == {"e": "drift", "f": "ok"}
    row = scoring.book_rows(scoring.merged(tallies(spark)), claimed).first()
    assert (row.oges, row.ok, row.drift, row.match_rate, row.blank_page_share, row.solution_coverage) == (2, 1, 1, 0.5, 0.333, 0.0)
    marks = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 2.0)], "v double, l double").select(scoring.mark(F.col("v"), F.col("l")).alias("m"), scoring.delta_text(F.col("v"), F.lit(1.5)).alias("d")).collect()
    assert [(r.m, r.d) for r in marks] == [("PASS", "1.0 (-0.5)"), ("FAIL", "3.0 (+1.5)"), ("NOT MEASURED", "-")]
    docs = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "book_id string, fingerprint string")
    good, bad = scoring.baked_scores(docs, spark.createDataFrame([("a", "1"), ("b", "2")], "book_id string, fingerprint string"))
    assert [r.book_id for r in good.collect()] == ["a"] and {r.book_id: r.why for r in bad.collect()} == {"b": "diagnostics are stale", "c": "no diagnostics"}
    assert scoring.evaluation(spark.createDataFrame([], "book_id string, pages int, regions int, oges int, matched int, panels_cut int, solutions_cut int, overlaps int, tall int, slivers int, pages_with_regions int, loss double")).first().loss == float("inf")


def test_subsets_splits_and_small_predicates(spark):
    im = spark.createDataFrame([(i,) for i in range(20)], "id long")
    few, notes = labels.subset(im, spark.createDataFrame([(i, i % 20) for i in range(60)], "id long, image_id long"), 4)
    assert sorted(r.id for r in few.collect()) == [0, 5, 10, 15] and {r.image_id for r in notes.collect()} == {0, 5, 10, 15} and notes.count() == 12
    s = spark.createDataFrame([("a", "train", "t"), ("a", "test", "t"), ("x", "train", "t"), ("b", "train", "u")], "book_id string, split string, template string")
    f = labels.split_faults(s, spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t")], "book_id string, template string"))
    assert {(r.book_id, r.fault) for r in f.collect()} == {("a", "in several splits"), ("x", "unknown book"), ("b", "template changed"), ("c", "without split")}
    v = spark.createDataFrame([([0.0], None), (None, [1.0, 1.0, 1.0]), (None, [1.0, 0.5, 1.0]), (None, None)], "s array<double>, f array<double>").select(labels.visible(F.col("s"), F.col("f")).alias("v"))
    assert [r.v for r in v.collect()] == [True, False, True, False]
    a = spark.createDataFrame([(True, 10.0), (False, 8.0), (False, 9.5), (None, None)], "r boolean, s double").select(labels.is_aside(F.col("r"), F.col("s"), F.lit(10.0)).alias("a"))
    assert [r.a for r in a.collect()] == [True, True, False, False]
