"""Catalogue, manifest, log and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import replies
from pagewright.functions import text as tx
from pagewright.functions.keys import guid
from pagewright.operators import fitting, library, metrics, sampling, views
from pagewright.plans import aggregates, joins
from pagewright.session import table
from pagewright.sources import readers

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_FOLD = "lower(translate({}, 'İIıŞşĞğÇçÖöÜüÂâÎîÛû', 'iiissggccoouuaaiiuu'))"
_BOOKS = """kb AS (SELECT id, max(baslik) AS title, coalesce(max(TRY_CAST(nullif(regexp_extract(baslik, '^([0-9]+)\\.', 1), '') AS INTEGER)), 0) AS grade, max(sayfasayisi) AS page_count, bool_or(silinme_zamani IS NULL) AS live, min(lower(klasoradi)) AS folder FROM kitap WHERE id IS NOT NULL GROUP BY 1),
bk AS (SELECT kb.*, live AND EXISTS (SELECT 1 FROM sheets s WHERE s.book_id = kb.folder) AND page_count > 100 AS installed FROM kb)"""


def _books(spark, d) -> DataFrame:
    """One row a book; here one counts as installed where it is live, its sheets are loaded and it has over 100 pages."""
    k = table(spark, d, "kitap").where("id is not null")
    grade = F.expr("try_cast(nullif(regexp_extract(baslik, '^([0-9]+)\\\\.', 1), '') as int)")
    b = k.groupBy("id").agg(F.max("baslik").alias("title"), F.coalesce(F.max(grade), F.lit(0)).alias("grade"), F.max("sayfasayisi").alias("page_count"), F.bool_or(F.col("silinme_zamani").isNull()).alias("live"), F.min(F.lower("klasoradi")).alias("folder"))
    s = table(spark, d, "sheets").select(F.col("book_id").alias("folder")).distinct().withColumn("_s", F.lit(True))
    return b.join(s, "folder", "left").withColumn("installed", F.coalesce(F.col("live") & F.col("_s").isNotNull() & (F.col("page_count") > 100), F.lit(False))).drop("_s")


@query(f"""WITH {_BOOKS}, s AS (SELECT id, CASE WHEN coalesce(installed, false) THEN 'installed' WHEN grade IN (9, 10, 11, 12) THEN grade::VARCHAR ELSE '0' END AS section, {_FOLD.format('title')} AS t FROM bk)
SELECT id, section, row_number() OVER (PARTITION BY section ORDER BY t, id) AS number FROM s""")
def catalogue_sections(spark, d) -> DataFrame:
    """The library's sections: installed books first, the rest by grade, by folded title within."""
    return library.sections(_books(spark, d).withColumn("grade", F.when(F.col("grade").isin(9, 10, 11, 12), F.col("grade")).otherwise(0))).select("id", "section", "number")


@query(f"""WITH {_BOOKS} SELECT id FROM bk WHERE grade = 9 AND contains({_FOLD.format('title')}, 'okuma')""")
def catalogue_search(spark, d) -> DataFrame:
    """Books of a grade whose folded title holds a folded needle."""
    b = _books(spark, d).withColumn("grade_label", F.concat(F.col("grade").cast("string"), F.lit(". sinif")))
    return library.filtered(b, 9, "OKUMA").select("id")


@query(f"""WITH {_BOOKS} SELECT id FROM bk WHERE contains(lower(id), 'a1') OR contains(lower(title), 'a1') OR contains(lower(id), 'harita') OR contains(lower(title), 'harita')""")
def only_substrings(spark, d) -> DataFrame:
    """Books of which any of several needles is in the id or title."""
    return library.only(_books(spark, d), ["A1", "harita"], ["id", "title"]).select("id")


@query("""WITH m AS (SELECT max(kayit_zamani) - INTERVAL 30 DAY AS cut FROM kitap), o AS (SELECT id, max(sayfasayisi) AS n, max(status) AS s FROM kitap, m WHERE kayit_zamani <= cut AND (silinme_zamani IS NULL OR silinme_zamani > cut) GROUP BY 1),
w AS (SELECT id, max(sayfasayisi) AS n, max(status) AS s FROM kitap WHERE silinme_zamani IS NULL GROUP BY 1)
SELECT coalesce(w.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' WHEN o.n IS NOT DISTINCT FROM w.n AND o.s IS NOT DISTINCT FROM w.s THEN 'same' ELSE 'changed' END AS change FROM w FULL JOIN o ON o.id = w.id""")
def catalogue_changes(spark, d) -> DataFrame:
    """What came, went or changed in the catalogue within the last thirty days."""
    k = table(spark, d, "kitap")
    m = k.agg((F.max("kayit_zamani") - F.expr("interval 30 days")).alias("cut"))
    old = k.join(F.broadcast(m)).where("kayit_zamani <= cut and (silinme_zamani is null or silinme_zamani > cut)")  # one row is broadcast

    def state(df: DataFrame) -> DataFrame:
        return df.groupBy("id").agg(F.max("sayfasayisi").alias("n"), F.max("status").alias("s"))

    return library.changes(state(k.where("silinme_zamani is null")), state(old), "id")


@query(f"""WITH {_BOOKS}, sz AS (SELECT book_id AS folder, count(*) AS size FROM sheets GROUP BY 1), c AS (SELECT book_id AS folder, max(label) AS confidence FROM activity GROUP BY 1)
SELECT bk.id, coalesce(installed, false) AS installed, size, coalesce(confidence, 'none') AS confidence FROM bk LEFT JOIN sz USING (folder) LEFT JOIN c USING (folder)""")
def catalogue_enriched(spark, d) -> DataFrame:
    """Books with what is known of them from their sheets and regions."""
    b = _books(spark, d)
    by = b.select("id", "folder")
    sizes = table(spark, d, "sheets").groupBy(F.col("book_id").alias("folder")).agg(F.count(F.lit(1)).alias("size")).join(by, "folder").select("id", "size")
    bakes = table(spark, d, "activity").groupBy(F.col("book_id").alias("folder")).agg(F.max("label").alias("confidence")).join(by, "folder").select("id", "confidence")
    none = spark.createDataFrame([], "id string, seq int, state string")
    return library.enriched(b.drop("installed"), b.where("installed").select("id"), sizes, bakes, none).select("id", "installed", "size", "confidence")


@query("""WITH l AS (SELECT user_id AS user, event_type || '-' || CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS id, max(ts) AS seen FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY seen DESC, id) AS place FROM l QUALIFY place <= 8),
o AS (SELECT * FROM r WHERE id NOT LIKE 'error%') SELECT user, id, row_number() OVER (PARTITION BY user ORDER BY place) AS place FROM o""")
def recent_openable(spark, d) -> DataFrame:
    """Each user's last things that can still be opened, in the list's order."""
    e = table(spark, d, "events").select(F.col("user_id").alias("user"), F.concat("event_type", F.lit("-"), (F.get_json_object("props", "$.k").cast("long") % 7).cast("string")).alias("id"), "ts")
    known = e.select("id").distinct()
    r = library.recents(e, "user", "id", "ts").drop("ts")
    return library.openable(r, known, ~F.startswith("id", F.lit("error"))).select("user", "id", F.col("place").cast("long").alias("place"))


@query("""WITH f AS (SELECT DISTINCT lower(regexp_replace(id, '^[\\s{}]+|[\\s{}]+$', '', 'g')) AS id, 'Baslik: https://x/Etkilesimlikitap/' || lower(regexp_replace(klasoradi, '^[\\s{}]+|[\\s{}]+$', '', 'g')) || '/pdf.pdf' AS line FROM kitap WHERE id IS NOT NULL AND klasoradi IS NOT NULL)
SELECT f.id, regexp_extract(line, '/([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})/', 1) AS folder, trim(regexp_extract(line, '^(.*?):\\s*https?://', 1)) AS title, (SELECT count(DISTINCT page) FROM sheets s WHERE s.book_id = regexp_extract(line, '/([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})/', 1)) AS n_sheets FROM f""")
def catalogue_parse_join(spark, d) -> DataFrame:
    """Catalogue lines parsed, joined to their books' sheets."""
    k = table(spark, d, "kitap").where("id is not null and klasoradi is not null").select(guid("id").alias("id"), F.concat(F.lit("Baslik: https://x/Etkilesimlikitap/"), guid("klasoradi"), F.lit("/pdf.pdf")).alias("line")).distinct()
    p = k.select("id", F.regexp_extract("line", r"(?i)/([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})/", 1).alias("folder"), F.trim(F.regexp_extract("line", r"^(.*?):\s*https?://", 1)).alias("title"))
    n = table(spark, d, "sheets").groupBy(F.col("book_id").alias("folder")).agg(F.countDistinct("page").alias("n_sheets"))
    return p.join(n, "folder", "left").select("id", "folder", "title", F.coalesce("n_sheets", F.lit(0)).alias("n_sheets"))


@query("SELECT DISTINCT id, ogeturu, sayfano, title, data, posx, posy, sayfaustuoge FROM publisher_oge WHERE ogeturu = 1 AND length(data) > 0")
def manifest_pruned_projection(spark, d) -> DataFrame:
    """The slim manifest: eight fields of the entries that the catalogue counts."""
    o = table(spark, d, "publisher_oge").select("id", "ogeturu", "sayfano", "title", "data", "posx", "posy", "sayfaustuoge")
    return o.where((F.col("ogeturu") == 1) & (F.length("data") > 0)).distinct()


@query("""WITH o AS (SELECT DISTINCT id, ogeturu, data, sayfano FROM publisher_oge WHERE id IS NOT NULL), h AS (SELECT id, '<img src="/' || coalesce(nullif(data, ''), 'yok') || '/' || coalesce(sayfano, 0) || '.png?v=1"><a href="#top">x</a><div style="background:url(' || coalesce(ogeturu, 0) || '.css)"><script src="http://x/y.js"></script>' AS html FROM o)
SELECT id, count(*) AS n_pages, sum(2)::BIGINT AS n_assets, max(substr(html, 12, position('?' IN html) - 12)) AS last FROM h GROUP BY 1""")
def html_assets(spark, d) -> DataFrame:
    """Relative assets of entries' pages, written here from the entry's fields."""
    o = table(spark, d, "publisher_oge").where("id is not null").select("id", "ogeturu", "data", "sayfano").distinct()
    html = F.concat(F.lit('<img src="/'), F.coalesce(F.nullif("data", F.lit("")), F.lit("yok")), F.lit("/"), F.coalesce("sayfano", F.lit(0)).cast("string"), F.lit('.png?v=1"><a href="#top">x</a><div style="background:url('), F.coalesce("ogeturu", F.lit(0)).cast("string"), F.lit('.css)"><script src="http://x/y.js"></script>'))
    a = o.select("id", tx.html_assets(html).alias("a"))
    return a.groupBy("id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.size("a")).alias("n_assets"), F.max(F.get(F.filter("a", lambda x: replies.media_class(x) == "image"), F.lit(0))).alias("last"))


@query("""SELECT event_type AS key, count(*) AS n FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-05' AND value < 50 GROUP BY 1""")
def requests_of_a_day(spark, d) -> DataFrame:
    """Requests of one day and route per key; cheap events stand for the route."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.when(F.col("value") < 50, "api").otherwise("cli").alias("route"), F.col("event_type").alias("key"))
    return readers.requests_by_key(e, "2024-01-05")


@query(f"""WITH {views.SQL}, l AS (SELECT book_id, page, activity_key, label, headline, row_number() OVER (PARTITION BY book_id, page ORDER BY activity_key) AS number FROM act WHERE kind = 'activity'), it AS (SELECT activity_key, count(*) AS n, count(DISTINCT part_index) AS p FROM (SELECT DISTINCT item_key, activity_key, part_index FROM item) GROUP BY 1)
SELECT book_id, page, activity_key AS id, number, coalesce(n, 0) AS n_items, coalesce(p, 0) AS n_parts FROM l LEFT JOIN it USING (activity_key)""")
def activity_summaries(spark, d) -> DataFrame:
    """The side bar's list: activities numbered on their sheet, with their items."""
    a = views.activities(spark, d).select("book_id", "page", F.col("activity_key").alias("ord"), F.col("activity_key").alias("id"), "label", "headline", "kind")
    i = table(spark, d, "item").select("item_key", F.col("activity_key").alias("id"), "part_index").distinct()
    return library.summaries(a, spark.createDataFrame([], "id string, entry string"), i).select("book_id", "page", "id", F.col("number").cast("long").alias("number"), "n_items", "n_parts")


@query("""WITH b AS (SELECT book_id, min(coalesce(lower(trim(split)), 'train')) AS split FROM book_score GROUP BY 1), s AS (SELECT book_id, count(*) FILTER (WHERE printed) AS manifest, count(*) FILTER (WHERE NOT printed) AS empty FROM (SELECT book_id, page, bool_or(printed_page IS NOT NULL) AS printed FROM sheets GROUP BY 1, 2) GROUP BY 1)
SELECT b.book_id, b.split, manifest, empty FROM b JOIN s USING (book_id)""")
def selection_counts(spark, d) -> DataFrame:
    """Pages of each book by stratum, beside its split."""
    b = table(spark, d, "book_score").groupBy("book_id").agg(F.min(F.coalesce(F.lower(F.trim("split")), F.lit("train"))).alias("split"))
    s = table(spark, d, "sheets").groupBy("book_id", "page").agg(F.when(F.bool_or(F.col("printed_page").isNotNull()), "manifest").otherwise("empty").alias("stratum"))
    return b.join(s.groupBy("book_id").pivot("stratum", ["manifest", "empty"]).count().fillna(0), "book_id")


@query("""WITH s AS (SELECT DISTINCT * EXCLUDE (row_id) FROM book_score), r AS (SELECT book_id, sum(panels_cut + solutions_cut) / nullif(sum(regions), 0) AS rate FROM s GROUP BY 1)
SELECT CASE WHEN rate IS NULL THEN 'none' WHEN rate < 0.02 THEN 'low' WHEN rate < 0.07 THEN 'mid' ELSE 'high' END AS band, count(*) AS n_books, round(max(rate), 6) AS top FROM r GROUP BY 1""")
def violation_bands(spark, d) -> DataFrame:
    """Books by the band of their cut rate."""
    r = aggregates._scores(spark, d).groupBy("book_id").agg((F.sum(F.col("panels_cut") + F.col("solutions_cut")) / F.nullif(F.sum("regions"), F.lit(0))).alias("rate"))
    return r.groupBy(tx.band_of(F.col("rate")).alias("band")).agg(F.count(F.lit(1)).alias("n_books"), F.round(F.max("rate"), 6).alias("top"))


@query("""WITH e AS (SELECT event_type AS rule, user_id AS book, strftime(ts, '%Y-%m-%d') AS day FROM events) SELECT 'rule' AS by, rule AS value, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'book', book::VARCHAR, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'day', day, count(*) FROM e GROUP BY 2""")
def triage_histograms(spark, d) -> DataFrame:
    """Three histograms of refusals, from one pass over grouping sets."""
    e = table(spark, d, "events").select(F.col("event_type").alias("rule"), F.col("user_id").cast("string").alias("book"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    g = e.groupingSets([["rule"], ["book"], ["day"]], "rule", "book", "day").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    return g.select(F.when(F.col("_g") == 3, "rule").when(F.col("_g") == 5, "book").otherwise("day").alias("by"), F.coalesce("rule", "book", "day").alias("value"), "n")


@query("""WITH g AS (SELECT user_id, value, event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 5 = 0 AS y FROM events), k AS (SELECT user_id FROM g GROUP BY 1 HAVING sum(y::INT) = 1 AND count(*) > 1),
c AS (SELECT user_id FROM g SEMI JOIN k USING (user_id) GROUP BY 1 HAVING count(*) FILTER (WHERE value > 10) > 1), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM g SEMI JOIN c USING (user_id))
SELECT count(*) AS n_groups, coalesce(sum(y::INT), 0)::BIGINT AS n_right FROM t WHERE rn = 1""")
def top1_contested(spark, d) -> DataFrame:
    """The same accuracy over groups in which more than one row is a serious rival."""
    g = table(spark, d, "events").select("user_id", F.col("value").alias("score"), F.col("event_id").alias("ord"), (F.get_json_object("props", "$.k").cast("long") % 5 == 0).alias("y"))
    return metrics.top1(metrics.contested(g, "user_id", F.col("score") > 10), "user_id").select("n_groups", F.coalesce("n_right", F.lit(0)).alias("n_right"))


@query(f"""WITH {views.SQL}, r AS (SELECT book_id, (rect.x1 - rect.x0) * (rect.y1 - rect.y0) / (width * height) AS v FROM act JOIN sh USING (book_id, page) WHERE rect.y1 - rect.y0 <= 0.7 * height)
SELECT count(*) AS n, round(avg((v >= 0.05)::INT), 3) AS at_05, round(avg((v >= 0.1)::INT), 3) AS at_10, round(avg((v >= 0.2)::INT), 3) AS at_20 FROM r""")
def shares_at_thresholds(spark, d) -> DataFrame:
    """Regions that cover so much of their sheet, tall ones left out."""
    r = F.col("rect")
    a = views.activities(spark, d).join(views.sheets(spark, d), ["book_id", "page"]).where((r["y1"] - r["y0"]) <= 0.7 * F.col("height"))
    v = (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) / (F.col("width") * F.col("height"))
    return metrics.shares(a.withColumn("v", v), "v", {"at_05": 0.05, "at_10": 0.1, "at_20": 0.2})


@query("""WITH b AS (SELECT book_id, max(pages) AS pages FROM book_score GROUP BY 1), c AS (SELECT book_id, unnest(range(1, pages + 1, 80)) AS first, pages FROM b WHERE pages > 0), e AS (SELECT book_id, first, least(first + 79, pages) AS last FROM c)
SELECT book_id, first::BIGINT AS first, last::BIGINT AS last, row_number() OVER (ORDER BY last - first DESC, book_id, first) AS place FROM e""")
def work_chunks(spark, d) -> DataFrame:
    """Slices of eighty pages of every book, the largest first."""
    b = table(spark, d, "book_score").groupBy("book_id").agg(F.max("pages").cast("long").alias("pages"))
    return sampling.chunks(b)


@query(f"""WITH {joins._PLACED} SELECT book_id, page, entry_ord, region_ord, round(drift / (abs(drift) + 5), 6) AS f0, round(reach / (abs(reach) + 10), 6) AS f1, (coalesce(el = rl, false))::INT AS same_label FROM pr0 WHERE y IS NOT NULL AND x IS NOT NULL""")
def ranker_features(spark, d) -> DataFrame:
    """What a ranker sees of each pair of an entry and a region."""
    p = joins.matching.gated_pairs(*joins._placed(spark, d), ["book_id", "page"]).where("x is not null and y is not null")
    f = fitting.pair_features(p)
    return f.select("book_id", "page", "entry_ord", "region_ord", F.round(F.col("features")[0], 6).alias("f0"), F.round(F.col("features")[1], 6).alias("f1"), F.col("features")[4].cast("int").alias("same_label"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, 5 + l_quantity * 10 AS size, l_linenumber % 3 = 0 AS protected, l_shipdate AS shipped FROM lineitem),
h AS (SELECT *, sum(size) OVER (PARTITION BY l_orderkey ORDER BY protected DESC, shipped DESC, l_linenumber, size ROWS UNBOUNDED PRECEDING) AS held FROM (SELECT DISTINCT * FROM s)) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM h WHERE protected OR held <= 600""")
def budget_protected(spark, d) -> DataFrame:
    """What stays of each group when the oldest go under a budget and protected ones never do."""
    s = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (5 + F.col("l_quantity") * 10).alias("size"), (F.col("l_linenumber") % 3 == 0).alias("p"), "l_shipdate").distinct()
    held = F.sum("size").over(W.partitionBy("l_orderkey").orderBy(F.desc("p"), F.desc("l_shipdate"), "l_linenumber", "size").rowsBetween(W.unboundedPreceding, 0))
    return s.withColumn("held", held).where(F.col("p") | (F.col("held") <= 600)).select("l_orderkey", "l_linenumber")
