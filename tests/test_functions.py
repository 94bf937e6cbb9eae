import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as geo
from pagewright.functions import text as tx
from pagewright.functions.keys import guid


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize("title,page,label", [("42/a", 42, "a"), ("56b-ed2", 56, "b"), ("29/e ed", 29, "e"), ("33/h .ed2", 33, "h"), ("92/c.ed", 92, "c"), ("30/b ed ed", 30, "b"), ("247n .ed", 24, "n"), (None, 3, None), ("Okuma", 3, None)])
def test_entry_labels(spark, title, page, label):
    assert one(spark, tx.entry_label(F.lit(title).cast("string"), F.lit(page))) == label


def test_markers_and_letters(spark):
    assert tuple(one(spark, tx.marker_label(F.lit("ç)")))) == ("letter", 3.5, "ç")
    assert tuple(one(spark, tx.marker_label(F.lit("12.")))) == ("digit", 12.0, "12")
    assert one(spark, tx.marker_label(F.lit("metin"))) is None


def test_fold_and_search(spark):
    assert one(spark, tx.fold(F.lit("COĞRAFYA İlk Işık"))) == "cografya ilk isik"
    assert one(spark, tx.matches(F.lit("ısı"), F.lit("Isı Yolculuğu"))) is True
    assert one(spark, tx.matches(F.lit(""), F.lit(None).cast("string"))) is True


def test_page_spec_and_assets(spark):
    assert one(spark, tx.page_spec(F.lit("16,23,10-12,x,9-2,99"), F.lit(40))) == [16, 23, 10, 11, 12]
    html = '<img src="/a/b.png?x=1"><a href="#top"><a href="http://x/y"><div style="background:url(c.css)"><img data-src="a/b.png">'
    assert one(spark, tx.html_assets(F.lit(html))) == ["a/b.png", "c.css"]


def test_rectangles(spark):
    a, b = geo.rect(0, 0, 10, 10), geo.rect(5, 5, 15, 15)
    assert one(spark, geo.iou(a, b)) == pytest.approx(25 / 175)
    assert one(spark, geo.cuts(a, b)) is True and one(spark, geo.cuts(a, geo.rect(1, 1, 2, 2))) is False
    assert one(spark, geo.cuts(a, geo.rect(3, 3, 3, 9))) is False
    assert one(spark, geo.encloses(a, geo.rect(-1, 0, 5, 5), 2.0)) is True


def test_guid(spark):
    assert one(spark, guid(F.lit(" {AB-1} "))) == "ab-1" and one(spark, guid(F.lit("{}"))) is None


def test_boxes_between_systems(spark):
    px = F.array(*[F.lit(float(v)) for v in (-5, 10, 100, 900)])
    assert tuple(one(spark, geo.px_to_points(px, F.lit(1000.0), F.lit(1000.0), F.lit(500.0), F.lit(800.0)))) == (0.0, 80.0, 50.0, 792.0)
    assert tuple(one(spark, geo.flip(geo.rect(1, 2, 3, 4), F.lit(10.0)))) == (1.0, 6.0, 3.0, 8.0)
    assert one(spark, geo.intersects(geo.rect(0, 0, 1, 1), geo.rect(1, 0, 2, 1))) is False and one(spark, geo.intersects(geo.rect(0, 0, 2, 2), geo.rect(1, 1, 3, 3))) is True
    assert one(spark, geo.fit_scale(F.lit(100.0), F.lit(200.0), F.lit(50.0), F.lit(50.0))) == 0.25


@pytest.mark.parametrize("turn", [0, 90, 180, 270, 450])
def test_screen_points_go_back(spark, turn):
    w, h, s = F.lit(600.0), F.lit(800.0), F.lit(1.5)
    sx, sy = geo.to_screen(F.lit(40.0), F.lit(70.0), w, h, F.lit(turn), s)
    x, y = geo.from_screen(sx, sy, w, h, F.lit(turn), s)
    r = spark.range(1).select(sx.alias("sx"), sy.alias("sy"), x.alias("x"), y.alias("y")).first()
    assert (r.x, r.y) == (pytest.approx(40.0), pytest.approx(70.0)) and 0 <= r.sx <= 1200 and 0 <= r.sy <= 1200


def test_paging(spark):
    from pagewright.functions import paging as pg

    assert [one(spark, pg.pages_for(F.lit(p), F.lit(6), True)) for p in (1, 2, 3, 6)] == [[1], [2, 3], [2, 3], [6]] and one(spark, pg.pages_for(F.lit(3), F.lit(6), False)) == [3]
    assert [one(spark, pg.next_page(F.lit(p), F.lit(6), True)) for p in (1, 3, 5, 6)] == [2, 4, 6, 6] and [one(spark, pg.previous_page(F.lit(p), True)) for p in (1, 2, 3, 6)] == [1, 1, 1, 4]
    assert one(spark, pg.next_page(F.lit(6), F.lit(6), False)) == 6 and one(spark, pg.previous_page(F.lit(1), False)) == 1


@pytest.mark.parametrize("text,asks", [("Metni dikkatle okuyunuz.", True), ("Yarın gelirsiniz.", False), ("Verdiğiniz karara göre ilerleriz", False), ("Kararınızı veriniz", True), ("Birlikte inceleyelim.", True), ("Read the text below", True), ("Now look at the picture", True),
                                       ("Reading is fun for all", False), ("devamı olan satırı okuyunuz.", False), ("a) devamı olan satırı okuyunuz.", True), ("1-5. soruları metne göre yanıtlayınız.", False), ("Neden?", False), ("• Maddeyi okuyunuz.", False), ("Bu neden böyledir? Uzun açıklama " + "x" * 150, False), (None, False)])
def test_questions(spark, text, asks):
    assert one(spark, tx.reads_as_question(F.lit(text).cast("string"))) is asks


def test_titles_labels_and_small_functions(spark):
    assert one(spark, tx.reads_as_title(F.lit("Etkinlik 3"), F.lit(10.0), F.lit(10.0))) is True and one(spark, tx.reads_as_title(F.lit("Etkinlik sırasında öğretmen bütün sınıfa sorular yöneltti."), F.lit(10.0), F.lit(10.0))) is False
    assert one(spark, tx.inline_label(F.lit("b) ikinci"))) == "b" and one(spark, tx.inline_label(F.lit("b)ikinci"))) is None
    assert one(spark, tx.is_bold(F.lit(16), F.lit("f"))) is True and one(spark, tx.is_bold(F.lit(0), F.lit("X-SemiBold"))) is True and one(spark, tx.is_bold(F.lit(4), F.lit(None).cast("string"))) is False
    assert one(spark, tx.is_prose(F.lit("metin"))) is True and one(spark, tx.is_prose(F.lit("a)"))) is False and one(spark, tx.is_prose(F.lit("—"))) is False
    assert [one(spark, tx.band_of(F.lit(v).cast("double"))) for v in (None, 0.0, 0.02, 0.07)] == ["none", "low", "mid", "high"]
    assert [one(spark, tx.human_size(F.lit(n))) for n in (5, 2048, 5 << 20, 3 << 30)] == ["5 B", "2.0 KB", "5.0 MB", "3.0 GB"]
