"""Queries that the test tables give no row, on rows that do."""

from pagewright.operators import layout, tally

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_furniture_stands_on_many_sheets_of_one_hand(spark):
    head, other = (40.0, 780.0, 200.0, 790.0), (40.0, 300.0, 200.0, 400.0)
    rows = [("b", p, f"h{p}", (head[0] + p % 3 * 0.2, *head[1:])) for p in (2, 4, 6, 8)] + [("b", p, f"o{p}", head) for p in (1, 3, 5)] + [("b", 2, "x", other), ("b", 2, "x2", None)]
    content = spark.createDataFrame(rows, f"book_id string, page int, id string, rect {RECT}")
    got = layout.furniture(content, spark.createDataFrame([("b", 40)], "book_id string, page_count int")).collect()
    assert {(r.id, r.pages) for r in got} == {(f"h{p}", 4) for p in (2, 4, 6, 8)}
    assert layout.furniture(content, spark.createDataFrame([("b", 400)], "book_id string, page_count int")).count() == 0


def test_folio_votes_gaps_and_collisions(spark):
    sheets = spark.createDataFrame([("b", 1, None), ("b", 2, None), ("b", 3, 1), ("b", 4, 2), ("b", 5, 2), ("b", 6, 4), ("c", 1, None)], "book_id string, page int, printed_page int")
    got = {(r.book_id, r.page): (r.book_offset, r.printed) for r in tally.folio(sheets).collect()}
    assert got == {("b", 1): (2, None), ("b", 2): (2, 0), ("b", 3): (2, 1), ("b", 4): (2, 2), ("b", 5): (2, 2), ("b", 6): (2, 4), ("c", 1): (0, 1)}
    assert {r.page: r.printed for r in tally.folio(sheets.where("book_id = 'b'"), first=4).collect()} == {1: None, 2: 0, 3: 1, 4: 2, 5: 3, 6: 4}
