"""Splits, samples, rankings, constraints, event-sourced state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import files
from pagewright.operators import sampling, state, views
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


@query("""WITH b AS (SELECT book_id, min(coalesce(template, '-')) AS template, min(coalesce(band, 'none')) AS band FROM book_score GROUP BY 1)
SELECT book_id, template, band, (row_number() OVER (PARTITION BY template, band ORDER BY book_id) - 1) % 3 = 1 AS held_out FROM b""")
def stratified_holdout(spark, d) -> DataFrame:
    """The second of each three books of a stratum is held out."""
    b = table(spark, d, "book_score").groupBy("book_id").agg(F.min(F.coalesce("template", F.lit("-"))).alias("template"), F.min(F.coalesce("band", F.lit("none"))).alias("band"))
    return sampling.every_third(b, ["template", "band"], "book_id")


_STRATA = f"""{views.SQL}, p AS (SELECT DISTINCT book_id, page FROM act WHERE kind = 'activity'), m AS (SELECT DISTINCT sh.book_id, sh.page FROM sh JOIN en ON en.book_id = sh.book_id AND en.sayfano = sh.printed_page),
x AS (SELECT sh.book_id, sh.page, CASE WHEN m.page IS NOT NULL THEN 'manifest' WHEN p.page IS NOT NULL THEN 'baked' ELSE 'empty' END AS stratum, md5(concat_ws('|', '1', sh.book_id, sh.page::VARCHAR)) AS h FROM sh LEFT JOIN p USING (book_id, page) LEFT JOIN m USING (book_id, page))"""


@query(f"""WITH {_STRATA}, k AS (SELECT *, row_number() OVER (PARTITION BY book_id, stratum ORDER BY h, page) AS k FROM x),
q AS (SELECT *, k <= CASE stratum WHEN 'manifest' THEN 14 WHEN 'baked' THEN 3 ELSE 3 END AS ok FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, CASE stratum WHEN 'baked' THEN 0 WHEN 'empty' THEN 1 ELSE 2 END, h, page) AS r FROM q)
SELECT book_id, page, stratum, NOT ok AS topped_up FROM r WHERE r <= 20""")
def stratified_sample_quota(spark, d) -> DataFrame:
    """Twenty sheets of each book by quotas of strata, topped up where one is short (a sampling operator)."""
    s = views.sheets(spark, d)
    has = views.activities(spark, d).where("kind = 'activity'").select("book_id", "page").distinct().withColumn("p", F.lit(True))
    named = s.join(views.entries(spark, d).select("book_id", F.col("sayfano").alias("printed_page")).distinct(), ["book_id", "printed_page"]).select("book_id", "page").distinct().withColumn("m", F.lit(True))
    x = s.join(has, ["book_id", "page"], "left").join(named, ["book_id", "page"], "left")
    x = x.select("book_id", "page", F.when(F.col("m").isNotNull(), "manifest").when(F.col("p").isNotNull(), "baked").otherwise("empty").alias("stratum"))
    return sampling.quota_sample(x, "book_id", "stratum", "page", 20, {"manifest": 0.7, "baked": 0.15, "empty": 0.15}, "baked", ["baked", "empty", "manifest"]).select("book_id", "page", "stratum", "topped_up")


@query("""WITH s AS (SELECT l_suppkey, l_orderkey, l_linenumber, greatest(0.0, CASE WHEN l_discount * 10 >= 0.5 THEN 1 - (l_discount * 10 - 0.5) / 0.4 ELSE 1 - (0.5 - l_discount * 10) / 0.5 END) AS doubt, l_returnflag = 'R' AS missing FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY missing DESC, round(doubt, 6) DESC, l_orderkey, l_linenumber) AS rank FROM s)
SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(doubt, 6) AS doubt, rank FROM r WHERE rank <= 38""")
def doubt_rank(spark, d) -> DataFrame:
    """The 38 most telling rows of each group: missing ones first, then by doubt (a top-k report)."""
    s = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(sampling.doubt(F.col("l_discount") * 10), 6).alias("doubt"), (F.col("l_returnflag") == "R").alias("missing"))
    w = W.partitionBy("l_suppkey").orderBy(F.desc("missing"), F.desc("doubt"), "l_orderkey", "l_linenumber")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 38").select("l_suppkey", "l_orderkey", "l_linenumber", "doubt", "rank")


@query("""WITH l AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS place FROM l)
SELECT user_id, event_type, place FROM r WHERE place <= 8""")
def recents_top8(spark, d) -> DataFrame:
    """Each user's latest kinds, newest first, each once, at most eight (a recents list)."""
    l = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), "event_type")).cast("long")
    return l.withColumn("place", place).where("place <= 8").select("user_id", "event_type", "place")


@query("""WITH s AS (SELECT DISTINCT book_id, lower(trim(split)) AS split FROM book_score WHERE split IS NOT NULL),
a AS (SELECT 'book in several splits' AS rule, count(*) AS n FROM (SELECT book_id FROM s GROUP BY 1 HAVING count(*) > 1)),
b AS (SELECT 'item without region' AS rule, count(*) AS n FROM item WHERE activity_key IS NOT NULL AND activity_key NOT IN (SELECT activity_key FROM activity WHERE activity_key IS NOT NULL)),
c AS (SELECT 'inverted rectangle' AS rule, count(*) AS n FROM activity WHERE rect.x1 <= rect.x0 OR rect.y1 <= rect.y0), e AS (SELECT 'repeated key' AS rule, count(*) AS n FROM (SELECT activity_key FROM activity GROUP BY 1 HAVING count(*) > 1))
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e
UNION ALL SELECT 'region of no sheet', count(*) FROM activity a WHERE NOT EXISTS (SELECT 1 FROM sheets s WHERE s.book_id = a.book_id AND s.page = a.page)
UNION ALL SELECT 'region outside its sheet', count(*) FROM activity a WHERE EXISTS (SELECT 1 FROM sheets s WHERE s.book_id = a.book_id AND s.page = a.page AND (a.rect.x0 < -2 OR a.rect.y0 < -2 OR a.rect.x1 > s.width + 2 OR a.rect.y1 > s.height + 2))
UNION ALL SELECT 'region under two points', count(*) FROM activity WHERE rect.x1 - rect.x0 <= 2 OR rect.y1 - rect.y0 <= 2""")
def dataset_constraints(spark, d) -> DataFrame:
    """How often each constraint of the labelled data is broken."""
    def counted(rule: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")

    act, items, sheets = table(spark, d, "activity"), table(spark, d, "item"), table(spark, d, "sheets").select("book_id", "page", "width", "height").distinct()
    out = act.join(sheets, ["book_id", "page"]).where("rect.x0 < -2 or rect.y0 < -2 or rect.x1 > width + 2 or rect.y1 > height + 2").select("book_id", "page", "activity_key")
    splits = table(spark, d, "book_score").where("split is not null").select("book_id", F.lower(F.trim("split")).alias("split")).distinct()
    return (counted("book in several splits", splits.groupBy("book_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
            .unionByName(counted("item without region", items.where("activity_key is not null").join(act.select("activity_key"), "activity_key", "left_anti")))
            .unionByName(counted("inverted rectangle", act.where("rect.x1 <= rect.x0 or rect.y1 <= rect.y0")))
            .unionByName(counted("region of no sheet", act.join(sheets, ["book_id", "page"], "left_anti")))
            .unionByName(counted("region outside its sheet", act.join(out, ["book_id", "page", "activity_key"], "left_semi")))
            .unionByName(counted("region under two points", act.where("rect.x1 - rect.x0 <= 2 or rect.y1 - rect.y0 <= 2")))
            .unionByName(counted("repeated key", act.groupBy("activity_key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))))


@query("""WITH l AS (SELECT user_id, event_type, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, count(*) AS n_sent FROM events GROUP BY 1, 2) SELECT * FROM l""")
def latest_request_per_key(spark, d) -> DataFrame:
    """Of each key the newest request replaces the pending one."""
    return state.latest(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")


@query("""WITH g AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN 3 ELSE 1 END AS lane, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS generation,
  count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id) AS now FROM events) SELECT user_id, event_id, generation FROM g WHERE event_type <> 'error' AND NOT (lane <= 1 AND generation < now)""")
def generation_stale_drop(spark, d) -> DataFrame:
    """Requests that are not stale: low lanes are dropped when their generation is past."""
    return state.drop_stale(table(spark, d, "events"))


@query("""WITH n AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS stroke, sum(CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS net FROM events GROUP BY 1, 2) SELECT user_id, stroke, net::BIGINT AS net FROM n WHERE net <> 0""")
def undo_net_diff(spark, d) -> DataFrame:
    """Net of added and removed strokes per id; what cancels out is gone."""
    e = table(spark, d, "events").withColumn("stroke", F.get_json_object("props", "$.k").cast("long"))
    sign = F.when(F.col("event_type").isin("click", "view"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return e.groupBy("user_id", "stroke").agg(F.sum(sign).alias("net")).where("net <> 0")


_PRINT = "octet_length(encode({c}))::VARCHAR || '-' || left(sha256({c} || {c} || {c}), 32)"


@query(f"""WITH k AS (SELECT id, {_PRINT.format(c="(coalesce(baslik, '') || '|' || coalesce(sayfasayisi::VARCHAR, '') || '|' || coalesce(status::VARCHAR, ''))")} AS f, kayit_zamani FROM kitap),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kayit_zamani DESC, f) AS n FROM k)
SELECT a.id, a.f AS fingerprint FROM r a WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM r b WHERE b.id = a.id AND b.n > 1 AND b.f = a.f)""")
def fingerprint_changed(spark, d) -> DataFrame:
    """Books whose latest delivery has a fingerprint (size, hash of head, middle and tail) that no earlier one had."""
    content = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("baslik", "sayfasayisi", "status")])
    k = table(spark, d, "kitap").select("id", files.fingerprint(F.encode(content, "UTF-8")).alias("fingerprint"), "kayit_zamani")
    r = k.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("kayit_zamani"), "fingerprint")))
    return r.where("n = 1").select("id", "fingerprint").join(r.where("n > 1").select("id", "fingerprint"), ["id", "fingerprint"], "left_anti")


@query("""WITH o AS (SELECT DISTINCT id, baslik, dersbaslik FROM kitap), g AS (SELECT id, coalesce(TRY_CAST(regexp_extract(baslik, '^([0-9]+)\\.', 1) AS INTEGER), 0) AS grade FROM o)
SELECT grade::BIGINT AS grade, count(DISTINCT id) AS n_books FROM g GROUP BY 1""")
def grade_sections(spark, d) -> DataFrame:
    """Catalogue sections by the grade that titles name, 0 for electives."""
    g = table(spark, d, "kitap").select("id", "baslik").distinct().select("id", F.coalesce(F.expr("try_cast(regexp_extract(baslik, '^([0-9]+)\\\\.', 1) as bigint)"), F.lit(0)).alias("grade"))
    return g.groupBy("grade").agg(F.countDistinct("id").alias("n_books"))


@query("""WITH a AS (SELECT DISTINCT book_id, page, lower(label) AS l FROM activity WHERE label IS NOT NULL AND kind = 'activity'), b AS (SELECT DISTINCT book_id, page FROM spans),
p AS (SELECT DISTINCT book_id, page FROM a) SELECT count(*) FILTER (WHERE p.page IS NOT NULL AND b.page IS NOT NULL) AS both, count(*) FILTER (WHERE b.page IS NULL) AS only_a, count(*) FILTER (WHERE p.page IS NULL) AS only_b FROM p FULL JOIN b ON p.book_id = b.book_id AND p.page = b.page""")
def label_agreement(spark, d) -> DataFrame:
    """Sheets that two sources of labels share or have alone."""
    a = table(spark, d, "activity").where("label is not null and kind = 'activity'").select("book_id", "page").distinct().withColumn("a", F.lit(True))
    b = table(spark, d, "spans").select("book_id", "page").distinct().withColumn("b", F.lit(True))
    j = a.join(b, ["book_id", "page"], "full")
    return j.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
