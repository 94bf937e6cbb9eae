"""Clean views of the project's tables that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.keys import guid
from pagewright.operators.skew import salted_join
from pagewright.session import table


def activities(spark, d: str) -> DataFrame:
    """Detected regions, each once."""
    return table(spark, d, "activity").select("activity_key", "book_id", "page", "id", "label", "col_no", "rect", "kind", "headline").distinct()


def sheets(spark, d: str) -> DataFrame:
    """One row a sheet that was ever loaded: (book_id, page, printed_page, width, height)."""
    return table(spark, d, "sheets").groupBy("book_id", "page").agg(
        F.min("printed_page").alias("printed_page"), F.max("width").alias("width"), F.max("height").alias("height"))


def folders(spark, d: str) -> DataFrame:
    """Distinct (kid, book_id): the publisher's and the project's GUID of a book."""
    return table(spark, d, "kitap").select(guid("id").alias("kid"), guid("klasoradi").alias("book_id")).where("kid is not null and book_id is not null").distinct()


def entries(spark, d: str) -> DataFrame:
    """Publisher entries, each once, with the project's book_id; x and y are null where no position is given."""
    e = table(spark, d, "publisher_oge").where("id is not null").select(
        "id", guid("kitapid").alias("kid"), "ogeturu", "sayfano", "title", "data", "posx", "posy", "sayfaustuoge").distinct()
    known = F.nanvl("posy", F.lit(None).cast("double")).isNotNull()
    return salted_join(e, folders(spark, d), ["kid"]).select(
        "id", "book_id", "ogeturu", "sayfano", "title", "data", "sayfaustuoge", "posx", "posy",
        F.when(known, F.nanvl("posx", F.lit(None).cast("double"))).alias("x"), F.when(known, F.col("posy")).alias("y"))


def interactive(c=F.col):
    """The predicate of interactive entries: type 1 with data, on the page, with a page number."""
    return (c("ogeturu") == 1) & (F.length(c("data")) > 0) & c("sayfaustuoge") & (c("sayfano") != 0)


def has_position(c=F.col):
    """Whether an entry names a point of its sheet: 0, 0 is none; an unknown one passes."""
    return ~F.coalesce((c("posx") == 0) & (c("posy") == 0), F.lit(False))


#: The same views as SQL common table expressions.
_G = "nullif(lower(regexp_replace({}, '^[\\s{{}}]+|[\\s{{}}]+$', '', 'g')), '')"
SQL = f"""act AS (SELECT DISTINCT activity_key, book_id, page, id, label, col_no, rect, kind, headline FROM activity),
sh AS (SELECT book_id, page, min(printed_page) AS printed_page, max(width) AS width, max(height) AS height FROM sheets GROUP BY 1, 2),
fo AS (SELECT DISTINCT {_G.format('id')} AS kid, {_G.format('klasoradi')} AS book_id FROM kitap WHERE id IS NOT NULL AND klasoradi IS NOT NULL),
en0 AS (SELECT DISTINCT id, {_G.format('kitapid')} AS kid, ogeturu, sayfano, title, data, posx, posy, sayfaustuoge FROM publisher_oge WHERE id IS NOT NULL),
en AS (SELECT id, book_id, ogeturu, sayfano, title, data, sayfaustuoge, posx, posy,
  CASE WHEN posy IS NOT NULL AND NOT isnan(posy) AND NOT isnan(posx) THEN posx END AS x, CASE WHEN posy IS NOT NULL AND NOT isnan(posy) THEN posy END AS y FROM en0 JOIN fo USING (kid))"""
