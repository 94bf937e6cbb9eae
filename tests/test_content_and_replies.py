import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import replies
from pagewright.operators import content, sampling
from pagewright.operators import pages as pg
from pagewright.operators import parts as pt
from pagewright.streaming import requests
from tests.test_pages import prose, sheet


def test_content_is_what_activities_leave():
    s = sheet([*prose(60.0, 700.0, 4), *prose(60.0, 500.0, 4), *prose(60.0, 300.0, 4), (60.0, 100.0, 100.0, "kısa", 10.0, False)])
    activity = np.array([[50.0, 440.0, 300.0, 520.0]])
    got = content.content_regions(s, activity)
    assert len(got) == 2 and all(pt.overlap(g["box"], activity[0]) == 0 for g in got) and got[0]["box"][3] > 700 and got[0]["headline"].startswith("bu satır")
    assert content.content_regions(s, np.array([[0.0, 0.0, 600.0, 800.0]])) == []


def test_a_leaf_is_parted_around_an_activity():
    boxes = np.array([[50, 100, 300, 110], [50, 80, 100, 90], [50, 60, 100, 70], [50, 40, 300, 50]], float)
    groups = content.apart(boxes, np.arange(4), np.array([[120.0, 55.0, 300.0, 95.0]]))
    assert [g.tolist() for g in groups] == [[0], [1, 2], [3]]


def test_anchored_regions():
    s = sheet([*prose(60.0, 700.0, 3), *prose(60.0, 600.0, 3)])
    none = np.zeros((0, 4))
    r = content.anchored_region(s, 50.0, 705.0, none, none)
    assert r[3] == 713 and 660 < r[1] < 680 and content.anchored_region(s, 50.0, 20.0, none, none) is None
    assert content.anchored_region(s, 50.0, 705.0, np.array([[40.0, 650.0, 320.0, 720.0]]), none).tolist() == [40, 650, 320, 720]


def test_detected_boxes_settle():
    boxes = np.array([[50, 100, 300, 200], [60, 110, 290, 190], [50, 195, 300, 300], [0, 0, 600, 790]], float)
    got = content.settle_boxes(boxes, np.array([0.9, 0.8, 0.7, 0.99]), np.zeros((0, 4)), np.zeros((0, 4)), 800.0)
    assert [g["owner"] for g in got] == [0, 2] and pt.overlap(got[0]["box"], got[1]["box"]) == 0
    m = np.array([[60, 180, 70, 190], [55, 190, 65, 199], [250, 190, 260, 199]], float)
    assert content.marker_for(boxes[0], m, set()) == 1 and content.marker_for(boxes[0], m, {1}) == 0 and content.marker_for(boxes[0], m, {0, 1}) is None


def test_holes_and_sub_questions():
    assert content.fill_holes([1, None, 3]) == [1, 2, 3] and content.fill_holes([1, None, None, 4, 5]) == [1, 2, 3, 4, 5]
    assert content.fill_holes([1, None, 4]) is None and content.fill_holes([1, None, None, None, 5]) is None and content.fill_holes([None, 2]) is None and content.fill_holes([1, 2]) is None
    box = np.array([[10, 90, 12, 92], [10, 70, 12, 72], [90, 50, 92, 52]], float)
    assert content.sub_questions([("letter", 1.0), ("letter", 2.0), ("digit", 7.0)], box) == [0, 1] and content.sub_questions([("digit", 7.0)], box[2:]) == []
    assert pg.counts_from_one([("letter", 3.0), ("letter", 3.5)]) is False


@pytest.mark.parametrize("text,want", [('Here: ```json\n[{"box": [1, 2, 3, 4], "label": "a]"}]\n```', '[{"box": [1, 2, 3, 4], "label": "a]"}]'), ("[not json] then [1, 2]", "[1, 2]"), ("[1, 2", None), ("", None), ('x ["a\\"]", 1] y', '["a\\"]", 1]')])
def test_lists_in_prose(text, want):
    assert replies.balanced_list(text) == want


def test_boxes_errors_and_media(spark):
    df = spark.createDataFrame([('[{"box":[0,10,500,1000],"label":"a"}]',), ("sorry",), (None,)], "r string").select(replies.boxes_in(F.col("r")).alias("b"))
    assert [r.b and [x.label for x in r.b] for r in df.collect()] == [["a"], None, None]
    b = spark.createDataFrame([([0.0, 10.0, 500.0, 1000.0],), ([0.0, 1.0],), ([5.0, 0.0, 1.0, 9.0],), ([0.0, 0.0, 1.0, 1001.0],), (None,)], "b array<double>").select(replies.box_fault(F.col("b")).alias("f"), replies.scaled_box(F.col("b"), F.lit(200), F.lit(100)).alias("s")).collect()
    assert [r.f for r in b] == [None, "not four numbers", "inverted", "out of range", "not four numbers"] and b[0].s == [0.0, 1.0, 100.0, 100.0]
    kind, wait = replies.error_class(F.col("c"), F.col("m"))
    e = spark.createDataFrame([(429, "Quota exceeded per day"), (429, "retry after 7.5 s"), (429, None), (503, ""), (403, ""), (400, "")], "c int, m string").select(kind.alias("k"), wait.alias("w")).collect()
    assert [(r.k, r.w) for r in e] == [("quota", 0.0), ("rate", 7.5), ("rate", 30.0), ("server", 5.0), ("key", 0.0), ("other", 0.0)]
    m = spark.createDataFrame([("a/b.MP3",), ("x.png",), ("x.webm",), ("x",)], "p string").select(replies.media_class(F.col("p")).alias("m"))
    assert [r.m for r in m.collect()] == ["audio", "image", "video", "other"]


def test_samples(spark):
    pages = spark.createDataFrame([("b", p, p % 4 == 0) for p in range(40)] + [("c", 1, True)], "book string, page int, empty boolean")
    got = sampling.self_labels(pages, "book", "page", "empty", 10, 0.2).collect()
    assert sum(r.book == "b" for r in got) == 10 and sum(r.empty for r in got if r.book == "b") == 2 and sum(r.book == "c" for r in got) == 1
    assert {r.book: r["count"] for r in sampling.fraction(pages, ["book"], "page", 0.1).groupBy("book").count().collect()} == {"b": 4, "c": 1}
    assert sampling.systematic(pages.where("book = 'b'"), "page", 10).count() == 10
    s = spark.createDataFrame([("b", p, p % 2, p / 100) for p in range(60)] + [("h", 1, 1, 0.5)], "book string, page int, missing int, doubt double")
    nxt = sampling.asked_next(s, s.where("page = 59"), s.where("book = 'h'").select("book"), "book", "page", 5).orderBy("place").collect()
    assert [r.page for r in nxt] == [49, 51, 53, 55, 57] and [r.place for r in nxt] == [1, 2, 3, 4, 5]
    c = sampling.chunks(spark.createDataFrame([("a", 170), ("b", 80), ("c", 0)], "book_id string, pages int")).orderBy("place").collect()
    assert [(r.book_id, r["first"], r["last"]) for r in c] == [("a", 1, 80), ("a", 81, 160), ("b", 1, 80), ("a", 161, 170)]
    i = sampling.interleaved(spark.createDataFrame([(x, n) for x, n in zip("abcde", (5, 4, 3, 2, 1), strict=True)], "book_id string, pages int")).orderBy("place").collect()
    assert [r.book_id for r in i] == ["a", "e", "b", "d", "c"]
    d = spark.createDataFrame([([0.5, 0.9],), ([],)], "s array<double>").select(sampling.page_doubt(F.col("s")).alias("d"))
    assert [r.d for r in d.collect()] == [1.0, 0.0]
    k = spark.createDataFrame([([(0.9,), (0.8,)],), ([(0.9,), (0.1,)],), ([],)], "b array<struct<score:double>>").select(sampling.sure_boxes(F.col("b"), 0.5).alias("k"))
    assert [None if r.k is None else len(r.k) for r in k.collect()] == [2, None, 0]


def test_pacing_and_chunks(spark):
    r = spark.createDataFrame([("k", 0.0, False), ("k", 1.0, True), ("k", 2.0, False), ("m", 0.0, True), ("m", 1.0, True), ("m", 2.0, True), ("m", 3.0, False)], "key string, at double, failed boolean")
    got = {(x.key, x.at): x.starts for x in requests.paced(r, "key", "at", 5.0, 60.0, 3).collect()}
    assert got == {("k", 0.0): 0.0, ("k", 1.0): 5.0, ("k", 2.0): 65.0, ("m", 0.0): 0.0, ("m", 1.0): 60.0, ("m", 2.0): 120.0, ("m", 3.0): None}
    c = spark.createDataFrame([("q", 1, "old"), ("q", 2, "new"), ("p", 1, "own")], "query string, token int, hit string")
    assert {x.hit for x in requests.current_chunks(c).collect()} == {"new", "own"}


def test_download_states_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1, "queued", 0, 10), ("a", 3, "running", 5, 10), ("a", 2, "running", 1, 10), ("b", 1, "done", 9, 9)], "id string, seq long, state string, done long, total long").write.parquet(f"{tmp_path}/s")
    events = requests.read_events(spark, f"{tmp_path}/s", "id string, seq long, state string, done long, total long")
    out = requests.run_once(requests.download_states(events), "states", "update", f"{tmp_path}/c")
    assert {r.id: (r.state, r.done, r.n_events) for r in out.collect()} == {"a": ("running", 5, 3), "b": ("done", 9, 1)}
