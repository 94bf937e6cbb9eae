"""Layout of sheets from their spans. In these tables a label is a row of its own above what it labels, hence ``alone``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.operators import book, content, pages, tally, views
from pagewright.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark, d) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "spans"), views.sheets(spark, d)


@query()
def page_layout(spark, d) -> DataFrame:
    """Body size, columns, markers and content box of every sheet with text."""
    return pages.page_layout(*_read(spark, d), alone=True)


@query()
def page_columns(spark, d) -> DataFrame:
    return pages.page_columns(*_read(spark, d), alone=True)


@query()
def page_lines(spark, d) -> DataFrame:
    """Lines of the body, parted at channels."""
    return pages.page_lines(*_read(spark, d)).drop("text")


@query()
def page_markers(spark, d) -> DataFrame:
    return pages.page_markers(*_read(spark, d), alone=True)


@query()
def page_regions(spark, d) -> DataFrame:
    """Regions grown from the markers of every sheet."""
    return pages.page_regions(*_read(spark, d), alone=True)


@query()
def paragraph_sessionise(spark, d) -> DataFrame:
    """Paragraphs of every sheet by leading, size, indent and inline labels."""
    return pages.page_paragraphs(*_read(spark, d), alone=True)


@query()
def question_detect(spark, d) -> DataFrame:
    """Paragraphs that ask for something, and exercise titles, per book."""
    p = pages.page_paragraphs(*_read(spark, d), alone=True)
    return p.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.count_if(tx.reads_as_question(F.col("text"))).alias("n_questions"), F.count_if(tx.inline_label(F.col("text")).isNotNull()).alias("n_labelled"),
                                    F.count_if(tx.reads_as_title(F.col("text"), F.col("size"), F.lit(10.0))).alias("n_titles"))


_BODY = "sp AS (SELECT s.book_id, s.page, s.ord, s.bbox.x0 AS x0, s.bbox.y0 AS y0, s.bbox.x1 AS x1, s.bbox.y1 AS y1 FROM spans s JOIN sh USING (book_id, page) WHERE s.bbox IS NOT NULL AND s.size IS NOT NULL AND length(trim(s.text, ' ')) > 0 AND s.bbox.y0 >= 42 AND s.bbox.y1 <= sh.height - 38)"
ORACLES["page_lines"] = f"""WITH RECURSIVE {views.SQL}, {_BODY}, s AS (SELECT *, (y0 + y1) / 2 AS mid, row_number() OVER (PARTITION BY book_id, page ORDER BY (y0 + y1) / 2 DESC, ord) AS k FROM sp),
st AS (SELECT book_id, page, k, mid AS first, 1 AS row FROM s WHERE k = 1
  UNION ALL SELECT s.book_id, s.page, s.k, CASE WHEN abs(st.first - s.mid) < 2.5 THEN st.first ELSE s.mid END, CASE WHEN abs(st.first - s.mid) < 2.5 THEN st.row ELSE st.row + 1 END FROM st JOIN s ON s.book_id = st.book_id AND s.page = st.page AND s.k = st.k + 1),
g AS (SELECT s.*, st.row, x0 - max(x1) OVER (PARTITION BY s.book_id, s.page, row ORDER BY x0, s.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 10 AS brk FROM s JOIN st USING (book_id, page, k)),
p AS (SELECT *, sum(coalesce(brk, false)::INT) OVER (PARTITION BY book_id, page, row ORDER BY x0, k) AS piece FROM g)
SELECT book_id, page, row_number() OVER (PARTITION BY book_id, page ORDER BY row, piece) AS line, count(*) AS n_spans, round(min(x0), 4) AS x0, round(min(y0), 4) AS y0, round(max(x1), 4) AS x1, round(max(y1), 4) AS y1 FROM p GROUP BY book_id, page, row, piece"""


@query()
def content_regions(spark, d) -> DataFrame:
    """Regions of what the detected activities leave of every sheet."""
    spans, sheets = _read(spark, d)
    acts = views.activities(spark, d).where("kind = 'activity'").select("book_id", "page", "rect")
    return content.page_content(spans, sheets, acts, alone=True)


@query()
def sheet_kinds(spark, d) -> DataFrame:
    """What each book's sheets are, counted; the tables hold no pictures, so content regions stand for them."""
    spans, sheets = _read(spark, d)
    grounds = views.activities(spark, d).where("kind = 'content'").select("book_id", "page", "rect")
    kinds = book.page_kinds(sheets.select("book_id", "page", "width", "height"), book.page_rows(spans), grounds, pages.page_layout(spans, sheets))
    return kinds.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_sheets"), F.count("contents").alias("n_contents"), F.count_if("opener").alias("n_openers"), F.count("form").alias("n_forms"), F.count_if("bibliography").alias("n_bibliography"), F.count_if("plate").alias("n_plates"))


@query()
def book_matter(spark, d) -> DataFrame:
    """Where each book's front matter ends and its back matter begins."""
    spans, sheets = _read(spark, d)
    grounds = views.activities(spark, d).where("kind = 'content'").select("book_id", "page", "rect")
    kinds = book.page_kinds(sheets.select("book_id", "page", "width", "height"), book.page_rows(spans), grounds, pages.page_layout(spans, sheets))
    acts = views.activities(spark, d).where("kind = 'activity'").select("book_id", "page")
    return book.matter(kinds, tally.folio(sheets), acts).drop("contents")
