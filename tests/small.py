"""Small tables in the layout of the test data."""

ACTIVITY = "activity_key string, book_id string, page int, id string, label string, col_no int, rect struct<x0: double, y0: double, x1: double, y1: double>, kind string, headline string"
SHEETS = "book_id string, page int, width double, height double, printed_page int"
OGE = "id string, kitapid string, ogeturu int, sayfano int, title string, data string, posx double, posy double, sayfaustuoge boolean"


def saved(spark, path, regions=(), entries=(), printed=()):
    """Regions (key, book, page, label, left, top, right, bottom), entries (id, page, title, x, y) of book b; a sheet of 100 by 100 a printed page."""
    act = [(k, b, p, f"p{p}-{k}", label, 0, (float(x0), 100.0 - y1, float(x1), 100.0 - y0), "activity", None) for k, b, p, label, x0, y0, x1, y1 in regions]
    spark.createDataFrame(act, ACTIVITY).write.parquet(f"{path}/activity.parquet")
    spark.createDataFrame([("b", p, 100.0, 100.0, p) for p in printed], SHEETS).write.parquet(f"{path}/sheets.parquet")
    spark.createDataFrame([(i, "k", 1, p, t, "x", None if x is None else float(x), None if y is None else float(y), True) for i, p, t, x, y in entries], OGE).write.parquet(f"{path}/publisher_oge.parquet")
    spark.createDataFrame([("k", "b")], "id string, klasoradi string").write.parquet(f"{path}/kitap.parquet")
    return str(path)
