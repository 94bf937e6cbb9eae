import numpy as np
import pytest

from pagewright.operators import pages as pg
from pagewright.operators import parts as pt


def sheet(rows, width=600.0, height=800.0):
    """A sheet of (x0, y0, x1, text, size, bold); a row is ``size`` high."""
    box = np.array([[x0, y0, x1, y0 + size] for x0, y0, x1, _, size, _ in rows], float)
    return pg.Sheet(box, [r[3] for r in rows], np.array([r[4] for r in rows], float), np.array([r[5] for r in rows], bool), ["f"] * len(rows), width, height)


def prose(x0, y0, n, width=220.0, step=14.0):
    return [(x0, y0 - step * i, x0 + width, "bu satır koşan bir metindir ve uzundur", 10.0, False) for i in range(n)]


def two_columns():
    left = [(50.0, 700.0, 58.0, "a)", 10.0, True), (70.0, 700.0, 270.0, "Aşağıdaki metni okuyunuz.", 10.0, False), *prose(70.0, 686.0, 8, 200.0), (50.0, 500.0, 58.0, "b)", 10.0, True), (70.0, 500.0, 270.0, "Soruyu yanıtlayınız.", 10.0, False), *prose(70.0, 486.0, 8, 200.0)]
    right = [(320.0, 700.0, 328.0, "c)", 10.0, True), (340.0, 700.0, 540.0, "Boşlukları doldurunuz.", 10.0, False), *prose(340.0, 686.0, 16, 200.0)]
    return sheet(left + right)


def test_labels():
    assert pg.label("a)") == ("letter", 1.0) and pg.label("ç.") == ("letter", 3.5) and pg.label("12") == ("digit", 12.0) and pg.label("2. Adım") == ("step", 2.0)
    assert pg.label("0)") is None and pg.label("metin") is None and pg.label("") is None


def test_lines_part_at_channels():
    s = sheet([(50, 100, 90, "bir", 10, False), (95, 101, 130, "iki", 10, False), (200, 100, 240, "üç", 10, False), (50, 80, 90, "dört", 10, False)])
    assert [[int(i) for i in g] for g in pg.lines(s, np.arange(4))] == [[0, 1], [2], [3]]
    assert [[int(i) for i in g] for g in pg.lines(s, np.arange(4), None)] == [[0, 1, 2], [3]]


def test_columns_and_markers():
    lay = pg.read_layout(two_columns())
    assert len(lay["columns"]) == 2 and lay["size"] == 10.0
    assert [(m[1], m[2], m[3]) for m in lay["marks"]] == [("letter", 1.0, 0), ("letter", 2.0, 0), ("letter", 3.0, 1)]


def test_a_label_within_prose_is_no_marker():
    s = sheet([(40.0, 700.0, 52.0, "ve", 10.0, False), (54.0, 700.0, 62.0, "a)", 10.0, True), (64.0, 700.0, 200.0, "devamı", 10.0, False)])
    assert pg.read_layout(s)["marks"] == []


def test_regions_hold_their_own_text_and_do_not_overlap():
    s = two_columns()
    regions = pg.grown(s, pg.read_layout(s))
    assert [r["label"] for r in regions] == ["a)", "b)", "c)"]
    assert all(pt.overlap(a["box"], b["box"]) == 0 for n, a in enumerate(regions) for b in regions[n + 1:])
    a, c = regions[0]["box"], regions[2]["box"]
    assert a[1] < 600 < a[3] and a[2] < 310 and c[0] > 290 and c[3] - c[1] <= 0.695 * 800


def test_paragraphs_break_at_leading_size_indent_and_labels():
    rows = prose(50.0, 700.0, 4) + prose(50.0, 600.0, 2) + [(80.0, 570.0, 270.0, "girintili bir satır daha burada", 10.0, False), (80.0, 556.0, 270.0, "b) etiketli bir satır", 10.0, False), (80.0, 540.0, 270.0, "Başlık gibi büyük satır", 13.0, False)]
    s = sheet(rows)
    got = pg.paragraphs(s, pg.read_layout(s))
    assert [p["lines"] for p in got] == [4, 2, 1, 1, 1]
    assert [p["opens"] for p in got] == [True, True, False, True, False]


def test_reading_order_counts_down_columns_or_along_rows():
    grid = np.array([[10, 90, 12, 92], [60, 90, 62, 92], [10, 70, 12, 72], [60, 70, 62, 72]], float)
    assert pg.reads_as_list(grid, [("letter", v) for v in (1.0, 2.0, 3.0, 4.0)])
    assert pg.reads_as_list(grid, [("letter", v) for v in (1.0, 3.0, 2.0, 4.0)])
    assert not pg.reads_as_list(grid, [("letter", v) for v in (1.0, 4.0, 2.0, 3.0)]) and not pg.reads_as_list(grid[:2], [("letter", 1.0), ("digit", 2.0)])


def test_prompts_are_below_no_marker():
    s = sheet([(50.0, 700.0, 300.0, "Metinden hangi sonuca ulaşılır?", 10.0, False), *prose(50.0, 640.0, 5)])
    found = pg.prompts(s, pg.read_layout(s), lambda t: t.endswith("?"))
    assert [p["text"] for p in found] == ["Metinden hangi sonuca ulaşılır?"]


def test_empty_and_null_spans(spark):
    spans = spark.createDataFrame([("b", 1, 0, None, None, None, None, None), ("b", 1, 1, " ", (1.0, 1.0, 2.0, 2.0), "f", 10.0, 0)],
                                  "book_id string, page int, ord int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, font string, size double, flags int")
    sheets = spark.createDataFrame([("b", 1, 600.0, 800.0)], "book_id string, page int, width double, height double")
    for f in (pg.page_layout, pg.page_columns, pg.page_lines, pg.page_markers, pg.page_paragraphs, pg.page_regions):
        assert f(spans, sheets).count() == 0


def random_boxes(rng, n, size=60):
    xy = rng.uniform(0, 500, (n, 2))
    return np.hstack([xy, xy + rng.uniform(8, size, (n, 2))])


def test_separation_leaves_no_overlap():
    rng = np.random.default_rng(3)
    for _ in range(40):
        parts = [{"box": b.copy(), "owner": n, "column": 0} for n, b in enumerate(random_boxes(rng, 12, 90))]
        out = pt.separate(parts, random_boxes(rng, 20, 30), passes=30)
        assert all(pt.overlap(a["box"], b["box"]) <= 1e-9 for n, a in enumerate(out) for b in out[n + 1:])


def test_seams_touch_no_wall():
    walls = np.array([[0, 10, 50, 20], [0, 30, 50, 40], [200, 0, 250, 100]], float)
    assert pt.seams(walls, 0.0, 50.0, 0.0, 60.0, 1).tolist() == [5.0, 25.0, 45.0]
    assert pt.seams(walls[:0], 0.0, 50.0, 0.0, 60.0, 1).tolist() == [25.0]


def test_blocks_are_taken_whole_or_left():
    parts = [{"box": np.array([0.0, 0.0, 100.0, 100.0]), "owner": 0, "column": 0}]
    pt.close_blocks(parts, np.array([[50.0, 50.0, 120.0, 90.0]]), 800.0)
    assert parts[0]["box"].tolist() == [0, 0, 120, 100]
    two = [{"box": np.array([0.0, 0.0, 100.0, 100.0]), "owner": 0, "column": 0}, {"box": np.array([104.0, 0.0, 200.0, 100.0]), "owner": 1, "column": 0}]
    pt.close_blocks(two, np.array([[90.0, 20.0, 130.0, 80.0]]), 800.0)
    assert not any(pt.is_cut(p["box"], np.array([90.0, 20.0, 130.0, 80.0])) for p in two)


def test_snapping_and_cleaning():
    block = np.array([[80.0, 0.0, 140.0, 100.0]])
    grown = pt.snap_edges([{"box": np.array([0.0, 0.0, 110.0, 100.0]), "owner": 0}], block)
    back = pt.snap_edges([{"box": np.array([0.0, 0.0, 90.0, 100.0]), "owner": 0}], block)
    assert grown[0]["box"].tolist() == [0, 0, 140, 100] and back[0]["box"].tolist() == [0, 0, 80, 100]
    out = pt.clean([{"box": np.array([0.0, 0.0, 3.0, 50.0])}, {"box": np.array([0.0, 0.0, 50.0, 700.0])}, {"box": np.array([49.9, 0.0, 90.0, 50.0])}], np.zeros((0, 4)), 800.0)
    assert len(out) == 2 and out[0]["box"][3] - out[0]["box"][1] <= 556 and out[0]["box"][2] == out[1]["box"][0] == pytest.approx(49.95)


def test_welding_is_the_closure_of_touching():
    rng = np.random.default_rng(5)
    for _ in range(20):
        b = random_boxes(rng, 15, 40)
        side = np.minimum(b[:, 2] - b[:, 0], b[:, 3] - b[:, 1])
        near = np.array([[max(max(b[i, 0], b[j, 0]) - min(b[i, 2], b[j, 2]), max(b[i, 1], b[j, 1]) - min(b[i, 3], b[j, 3])) <= max(6.0, min(30.0, 0.6 * min(side[i], side[j]))) for j in range(15)] for i in range(15)])
        closure = np.linalg.matrix_power(near.astype(int), 15) > 0
        got = pt.weld(b)
        assert ((got[:, None] == got[None, :]) == closure).all()
    pair = np.array([[0, 0, 10, 10], [14, 0, 24, 10]], float)
    assert pt.weld(pair).tolist() == [0, 0] and pt.weld(pair, gutters=np.array([[11.0, 0, 13.0, 10.0]])).tolist() == [0, 1]


def test_figures_and_captions():
    content = np.array([40.0, 44.0, 560.0, 760.0])
    tiles = np.array([[100, 400, 150, 450], [153, 400, 200, 450], [300, 300, 310, 310], [50, 500, 52, 502]], float)
    captions = np.array([[100, 385, 200, 395], [100, 300, 200, 310]], float)
    got = pt.figures(tiles, content, captions)
    assert [(f["box"].tolist(), f["caption"]) for f in got] == [([100, 400, 200, 450], 0)]
    assert pt.figures(np.zeros((0, 4)), content, captions) == []


def test_answer_spaces():
    rules = np.array([[100, y, 300, y + 1] for y in (100, 120, 140)] + [[x, 100, x + 1, 141] for x in (100, 200, 299)], float)
    got = pt.answer_spaces(rules, np.array([[210, 125, 280, 135]], float))
    assert [g["kind"] for g in got].count("grid") == 1 and [g["kind"] for g in got].count("cell") == 3
    open_ = pt.answer_spaces(np.array([[100, y, 300, y + 1] for y in (100, 120)], float), np.zeros((0, 4)))
    assert [g["box"].tolist() for g in open_] == [[100, 100.5, 300, 120.5], [100, 120.5, 300, 140.5]]
    assert pt.answer_spaces(np.zeros((0, 4)), np.zeros((0, 4))) == []


def test_strips_and_runs():
    assert pt.strips([100.0, 80.0, 70.0, 20.0], [True, True, True]) == [(100.0, 20.0)]
    assert pt.strips([100.0, 60.0, 50.0, 0.0], [False, True, False]) == [(100.0, 60.0), (60.0, 0.0)]
    assert pt.blocked_runs(np.array([[0, 80, 100, 90], [0, 60, 100, 70], [0, 10, 100, 20], [60, 0, 100, 5]], float), 50.0, 100.0, 0.0) == [(90.0, 60.0), (20.0, 10.0)]
    assert pt.coalesced([(9, 6, "a"), (6, 3, "a"), (3, 1, "b")]) == [(9, 3, "a"), (3, 1, "b")]
