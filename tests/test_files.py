import gzip
import json
import os

import pytest

from pagewright.functions import files
from pagewright.operators import scoring
from pagewright.sources import readers, sinks

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
ID = "03eb95bb-3a93-4f99-a2df-36d02f9c40d9"


def put(path, doc, zipped=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = (doc if isinstance(doc, str) else json.dumps(doc)).encode()
    with (gzip.open if zipped else open)(path, "wb") as f:
        f.write(data)
    return str(path)


def test_catalogue_with_its_index(spark, tmp_path):
    lines = readers.catalogue(spark, put(f"{tmp_path}/c.txt", f"Kitap: https://x/Etkilesimlikitap/{ID}/pdf.pdf\n\nkırık satır\n"))
    index = readers.catalogue_index(spark, put(f"{tmp_path}/i.json", {"books": {ID.upper(): {"title": "Yeni", "grade": "11. Sınıf", "pageCount": 7}}}))
    r = readers.catalogue_books(lines, index).first()
    assert (r.title, r.grade, r.page_count, r["index"]) == ("Yeni", 11, 7, 1)
    assert readers.catalogue_index(spark, f"{tmp_path}/none.json").count() == 0 and readers.catalogue_index(spark, put(f"{tmp_path}/bad.json", "{not")).count() == 0
    assert readers.catalogue_books(lines, readers.catalogue_index(spark, f"{tmp_path}/none.json")).first().grade == 9


def test_library_manifest_round(spark, tmp_path):
    p = put(f"{tmp_path}/m.json", {"count": 2, "books": [{"id": "b", "title": "İkinci", "grade": 9}, {"title": "kimliksiz"}, {"id": "a"}]})
    own = readers.library_manifest(spark, p)
    assert [(r.ord, r.id, r.title, r.grade, r.page_count) for r in own.orderBy("ord").collect()] == [(0, "b", "İkinci", 9, 0), (2, "a", "", 0, 0)]
    new = spark.createDataFrame([("b", "Baştan", 9), ("c", "Ağaç", 9)], "id string, title string, grade int")
    m = sinks.library_manifest(own.select("id", "title", "grade"), new).first()
    assert m["count"] == 3 and [x.id for x in m.books] == ["a", "c", "b"] and m.books[2].title == "Baştan"


def test_region_documents_round(spark, tmp_path):
    rows = [("b", 10, 0, "p10-a", "a", (1.00004, 2.0, 3.0, 4.0), "activity", None), ("b", 2, 0, "p2-x", None, (0.0, 0.0, 9.0, 9.0), "content", "Baş")]
    df = spark.createDataFrame(rows, f"book_id string, page int, ord int, id string, label string, rect {RECT}, kind string, headline string")
    docs = sinks.region_documents(sinks.disjoint(df))
    doc = json.loads(docs.first().json)
    assert list(doc["pages"]) == ["2", "10"] and "label" not in doc["pages"]["2"]["activities"][0] and doc["pages"]["10"]["activities"][0]["rect"] == [1.0, 2.0, 3.0, 4.0]
    sinks.write_documents(docs, f"{tmp_path}/regions")
    back = {r.page: r for r in readers.regions(spark, f"{tmp_path}/regions").collect()}
    assert back[2].headline == "Baş" and back[2].kind == "content" and back[10].rect.x1 == 3.0 and back[10].anchored is False
    with pytest.raises(Exception, match="regions overlap"):
        sinks.disjoint(spark.createDataFrame([("b", 1, 0, (0.0, 0.0, 9.0, 9.0)), ("b", 1, 1, (5.0, 5.0, 9.0, 9.0))], f"book_id string, page int, ord int, rect {RECT}"))


def test_items_and_versions(spark, tmp_path):
    act = {"id": "x", "label": "a", "rect": [0, 0, 1, 1], "items": [{"id": "i", "number": 1, "rect": [0, 0, 1, 1]}, {"id": "j", "number": 2, "partIndex": 1, "rect": [0, 0, 1, 1]}]}
    put(f"{tmp_path}/r/a.json", {"version": 1, "bookId": "b", "pages": {"3": {"activities": [act]}}})
    put(f"{tmp_path}/r/b.json", {"version": 9, "bookId": "c", "pages": {"3": {"activities": [act]}}})
    r = readers.regions(spark, f"{tmp_path}/r")
    assert [x.book_id for x in r.collect()] == ["b"]
    assert [(x.item_ord, x.id, x.part_index) for x in readers.region_items(r).orderBy("item_ord").collect()] == [(0, "i", 0), (1, "j", 1)]


def test_diagnostics_round_and_guard(spark, tmp_path):
    blocks = spark.createDataFrame([("b", 1, "panel", "p0", (0.0, 0.0, 5.00001, 5.0)), ("b", 1, "marker", "m0", (1.0, 1.0, 2.0, 2.0))], f"book_id string, page int, kind string, ord string, rect {RECT}")
    sheets = spark.createDataFrame([("b", 1, 600.00049, 800.0), ("b", 2, 600.0, 800.0)], "book_id string, page int, width double, height double")
    docs = sinks.diagnostics_documents(blocks, sheets, spark.createDataFrame([("b", "f1")], "book_id string, fingerprint string"))
    doc = json.loads(docs.first().json)
    assert doc["pages"]["1"]["panels"] == [[0.0, 0.0, 5.0, 5.0]] and doc["pages"]["1"]["pageWidth"] == 600.0 and doc["pages"]["2"]["markers"] == []
    sinks.write_documents(docs, f"{tmp_path}/d")
    back = readers.diagnostics(spark, f"{tmp_path}/d")
    assert {(r.page, r.kind, r.fingerprint) for r in back.collect()} == {(1, "panel", "f1"), (1, "marker", "f1")}
    put(f"{tmp_path}/one.json.gz", doc, zipped=True)
    assert readers.diagnostics(spark, f"{tmp_path}/one.json.gz").count() == 2
    _, refused = scoring.baked_scores(spark.createDataFrame([("b", "f2")], "book_id string, fingerprint string"), back)
    assert refused.first().why == "diagnostics are stale"


def test_traces_logs_and_indexes(spark, tmp_path):
    drops = spark.createDataFrame([("b", "marker", "typography")] * 2 + [("b", "marker", "no-run")] * 3, "book_id string, stage string, rule string")
    sinks.write_documents(sinks.trace_documents(drops), f"{tmp_path}/t")
    assert [(r.rule, r.n) for r in readers.traces(spark, f"{tmp_path}/t").collect()] == [("no-run", 3), ("typography", 2)]
    log = spark.createDataFrame([("2026-10-01T10:00:00Z", "api", "k1", 200), ("2026-10-01T11:00:00Z", "api", "k1", 500), ("2026-10-02T11:00:00Z", "api", "k1", 200), ("2026-10-01T11:00:00Z", "cli", "k2", 200)], "at string, route string, key string, status int")
    sinks.append_log(log.limit(2), f"{tmp_path}/log")
    sinks.append_log(log, f"{tmp_path}/log")
    put(f"{tmp_path}/log/broken.json", "{oops\n")
    assert {r.key: r.n for r in readers.requests_by_key(readers.request_log(spark, f"{tmp_path}/log"), "2026-10-01").collect()} == {"k1": 4}
    put(f"{tmp_path}/i.jsonl", '{"book":"b","page":1,"width_pt":595,"height_pt":842,"width_px":1190,"height_px":1684}\n' * 2)
    assert readers.page_index(spark, f"{tmp_path}/i.jsonl").first().width_px == 1190 and readers.page_index(spark, f"{tmp_path}/i.jsonl").count() == 1
    put(f"{tmp_path}/boxes.json", {"book": "b", "pages": {"7": [{"px": [0, 0, 1, 1], "score": 0.5}, {"px": [0, 0, 2, 2], "score": 0.9}], "8": []}})
    assert [(r.page, r.ord, r.score) for r in readers.predictions(spark, f"{tmp_path}/boxes.json").orderBy("ord").collect()] == [(7, 0, 0.5), (7, 1, 0.9)]


def test_folders(spark, tmp_path):
    for name in (f"a/{ID.upper()}.pdf", f"b/x-{ID}.pdf", "b/Adsız.pdf", "b/note.txt"):
        put(f"{tmp_path}/pdf/{name}", "x" * 5)
    got = {r.id: r for r in readers.pdf_files(spark, f"{tmp_path}/pdf").collect()}
    assert set(got) == {ID, "Adsız"} or set(got) >= {ID} and len(got) == 2
    assert got[ID].path.endswith(f"a/{ID.upper()}.pdf") and got[ID].size == 5
    put(f"{tmp_path}/l/b1/0003.json", {"boxes": [{"px": [0, 0, 1, 1], "label": "a"}]})
    put(f"{tmp_path}/l/b1/notes.json", {"boxes": []})
    put(f"{tmp_path}/l/batches/1.json", {"boxes": []})
    put(f"{tmp_path}/l/b1/4.failed", "timeout")
    labels, failed = readers.label_folder(spark, f"{tmp_path}/l")
    assert [(r.book, r.page, len(r.boxes)) for r in labels.collect()] == [("b1", 3, 1)] and [(r.book, r.page) for r in failed.collect()] == [("b1", 4)]


def test_strokes_settings_and_contents(spark, tmp_path):
    good = {"id": "s", "page": 1, "kind": "pen", "width": 2.0, "points": [0.04, 0.0, 5.0, 5.06], "created_ms": 5}
    put(f"{tmp_path}/ink/a.json", {"book": "b", "strokes": [good, {"id": "bad", "page": 1, "points": [1.0]}, {"id": None, "page": 1, "points": [0, 0, 1, 1]}]})
    put(f"{tmp_path}/ink/b.json", "{broken")
    s = readers.strokes(spark, f"{tmp_path}/ink")
    assert [r.id for r in s.collect()] == ["s"]
    assert json.loads(sinks.stroke_documents(s).first().json)["strokes"][0]["points"] == [0.0, 0.0, 5.0, 5.1]
    assert readers.settings(spark, f"{tmp_path}/none.json").first().asDict() == readers.SETTINGS
    assert readers.settings(spark, put(f"{tmp_path}/s.json", {"zoom": 2.5, "spread": True})).first().asDict() == readers.SETTINGS | {"zoom": 2.5, "spread": True}
    toc = spark.createDataFrame([("b", i, lv, f"t{i}", i) for i, lv in enumerate([1, 2, 9, 12, 2, 1])], "book_id string, ord long, level int, title string, page int")
    assert [r.parent for r in readers.contents_tree(toc).orderBy("ord").collect()] == [None, 0, 1, 2, 0, None]


def test_fingerprints_of_files(spark, tmp_path):
    import hashlib

    big = os.urandom(files.SPAN * 3 + 17)
    with open(f"{tmp_path}/big.bin", "wb") as f:
        f.write(big)
    put(f"{tmp_path}/small.bin", "kısa")
    got = {r.path.rsplit("/", 1)[1]: r.f for r in spark.read.format("binaryFile").load(f"{tmp_path}/*.bin").select("path", files.fingerprint(__import__("pyspark.sql.functions", fromlist=["col"]).col("content")).alias("f")).collect()}

    def want(b):
        n, s = len(b), files.SPAN
        return f"{n}-{hashlib.sha256(b''.join(b[a:a + s] for a in (0, max(0, n // 2 - s // 2), max(0, n - s)))).hexdigest()[:32]}"

    assert got == {"big.bin": want(big), "small.bin": want("kısa".encode())}


def test_scorecard_and_csv(spark, tmp_path):
    text, ok = sinks.scorecard(spark.createDataFrame([(12.0, 0.9, None)], "wall double, match double, ram double"), {"wall": (90, True), "match": (0.8, False), "ram": (500, True)})
    assert not ok and text.count("PASS") == 2 and "| ram | - | ≤ 500 | NOT MEASURED |" in text
    put(f"{tmp_path}/m.csv", "epoch,map,ema_map\n1,0.5,\n2,0.6,0.4\n3,,\n4,0.5,0.5\n")
    assert tuple(readers.best_epoch(spark, f"{tmp_path}/m.csv").first()) == (1, 0.5)


def test_trusted_labels_and_coco_pages(spark):
    v = spark.createDataFrame([(0, 0, "b", 1, "rejected", 0), (0, 1, "b", 1, "trusted", 2), (1, 0, "b", 1, "trusted", 0), (2, 0, "b", 1, "trusted", None)], "file_ord int, line_ord int, book string, page int, verdict string, hint_count int")
    assert [r.file_ord for r in readers.trusted_labels(v).collect()] == [1]
    im = spark.createDataFrame([(0, "b", 1), (1, "b", 2)], "id int, book string, page int")
    an = spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0, 4.0])], "id int, image_id int, bbox array<double>")
    assert {r.page: r.boxes for r in readers.coco_pages(im, an).collect()} == {1: [[1.0, 2.0, 4.0, 6.0]], 2: []}
