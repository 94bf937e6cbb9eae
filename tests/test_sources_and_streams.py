import json

from pagewright.operators import layout
from pagewright.sources import readers, sinks
from pagewright.streaming import requests


def test_catalogue_and_manifest(spark, tmp_path):
    u = "03eb95bb-3a93-4f99-a2df-36d02f9c40d9"
    (tmp_path / "c.txt").write_text(f"Kitap A: https://x/z/{u}/pdf.pdf\n\nkaputt\nKitap B: https://x/y/{u.upper()}/pdf.pdf\n")
    assert [(r["index"], r.title) for r in readers.catalogue(spark, str(tmp_path / "c.txt")).collect()] == [(1, "Kitap A"), (3, "Kitap B")]
    (tmp_path / f"{u}.json").write_text(json.dumps({"id": "k", "kitapogeList": [{"id": "o1", "ogeturu": 1, "posx": 3.5, "baslik": "42/a"}, {"id": "o2", "sayfano": 7}]}))
    rows = readers.manifest_entries(spark, str(tmp_path / f"{u}.json")).orderBy("ord").collect()
    assert [(r.file_id, r.id, r.sayfano, r.posx) for r in rows] == [(u, "o1", 0, 3.5), (u, "o2", 7, 0.0)]


def test_regions_round_trip(spark, tmp_path):
    doc = {"version": 2, "bookId": "b", "pages": {"10": {"pageWidth": 600.0, "pageHeight": 800.0, "activities": [{"id": "p10-a", "label": "a", "rect": [1, 2, 3, 4], "parts": [[1, 2, 3, 4]]}]}}}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    (tmp_path / "old.json").write_text(json.dumps(doc | {"version": 9}))
    r = readers.regions(spark, str(tmp_path))
    assert [(x.page, x.kind, x.rect.y1, x.column) for x in r.collect()] == [(10, "activity", 4.0, 0)]
    assert list(json.loads(sinks.region_documents(r).first().json)["pages"]) == ["10"]


def test_upsert(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), spark.createDataFrame([("b", 3)], "id string, v int")
    assert [tuple(r) for r in sinks.upsert(old, new, "id", ["id"]).collect()] == [("a", 1), ("b", 3)]


def test_stream_of_requests(spark, tmp_path):
    from datetime import datetime

    rows = [(i, datetime(2024, 1, 1, i % 5), i % 2, "view") for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    df.write.parquet(str(tmp_path / "in"))
    events = requests.read_events(spark, str(tmp_path / "in"), df.schema)
    out = requests.run_once(requests.latest_per_key(events), "latest_requests", "update", str(tmp_path / "c1")).collect()
    assert {(r.user_id, r.event_id, r.n_sent) for r in out} == {(0, 14, 10), (1, 19, 10)}
    assert requests.run_once(requests.windowed_counts(events), "windows", "complete", str(tmp_path / "c2")).count() == 5


def test_xy_cut(spark):
    rows = [(1, 0, 0.0, 90.0, 40.0, 100.0), (1, 1, 60.0, 90.0, 100.0, 100.0), (1, 2, 0.0, 20.0, 100.0, 30.0), (1, 3, 0.0, 8.0, 100.0, 18.0)]
    df = spark.createDataFrame(rows, "k int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert [r.leaf for r in layout.xy_cut(df, ["k"]).orderBy("ord").collect()] == [0, 1, 2, 2]
