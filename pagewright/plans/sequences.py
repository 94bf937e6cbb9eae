"""Lines, paragraphs, runs, numbering, searching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.operators import layout, sequence, views
from pagewright.operators.prefix import numbered
from pagewright.plans import joins
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


_LINES = """WITH RECURSIVE s AS (SELECT book_id, page, span_id, text, bbox, -bbox.y1 AS down, row_number() OVER (PARTITION BY book_id, page ORDER BY -bbox.y1, span_id) AS k FROM spans WHERE bbox IS NOT NULL),
st AS (SELECT book_id, page, k, down AS first, 1 AS line FROM s WHERE k = 1
  UNION ALL SELECT s.book_id, s.page, s.k, CASE WHEN s.down - st.first > 2.5 THEN s.down ELSE st.first END, CASE WHEN s.down - st.first > 2.5 THEN st.line + 1 ELSE st.line END FROM st JOIN s ON s.book_id = st.book_id AND s.page = st.page AND s.k = st.k + 1)"""


@query(f"""{_LINES} SELECT book_id, page, line, count(*) AS n_spans, round(min(bbox.x0), 3) AS x0, round(max(bbox.x1), 3) AS x1 FROM st JOIN s USING (book_id, page, k) GROUP BY 1, 2, 3""")
def anchor_lines(spark, d) -> DataFrame:
    """Lines of a sheet by the first span's top."""
    lines = sequence.text_lines(table(spark, d, "spans").where("bbox is not null"))
    return lines.select("book_id", "page", "line", "n_spans", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"))


@query(f"""WITH {views.SQL}, r AS (SELECT book_id, page, rect.y0 AS lo, rect.y1 AS hi, max(rect.y1) OVER (PARTITION BY book_id, page ORDER BY rect.y0, rect.y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM act)
SELECT book_id, page, round(reach, 4) AS gap_from, round(lo, 4) AS gap_to FROM r WHERE lo > reach""")
def interval_valleys(spark, d) -> DataFrame:
    """Clear horizontal bands between the regions of a sheet."""
    a = views.activities(spark, d).select("book_id", "page", F.col("rect.y0").alias("lo"), F.col("rect.y1").alias("hi"))
    return sequence.valleys(a, ["book_id", "page"], "lo", "hi").select("book_id", "page", F.round("gap_from", 4).alias("gap_from"), F.round("gap_to", 4).alias("gap_to"))


@query(f"""WITH i AS (SELECT DISTINCT activity_key, number FROM item WHERE number IS NOT NULL), g AS (SELECT activity_key, count(*) AS n, max(number) AS top, min(number) AS low FROM i GROUP BY 1)
SELECT n = top AND low = 1 AS from_one, count(*) AS n_regions, sum(n)::BIGINT AS n_items FROM g GROUP BY 1""")
def label_run_check(spark, d) -> DataFrame:
    """Regions whose items count from one without a hole."""
    i = table(spark, d, "item").where("number is not null").select("activity_key", F.col("number").cast("long").alias("number")).distinct()
    g = i.groupBy("activity_key").agg(F.collect_set("number").alias("ns"))  # a region's items are few
    return g.groupBy(sequence.counts_from_one(F.col("ns")).alias("from_one")).agg(F.count(F.lit(1)).alias("n_regions"), F.sum(F.size("ns")).alias("n_items"))


#: (kind, value) of a region's label in SQL: bare or with stops and brackets around it; Turkish letters stand half a step after their own.
_LABELS = """lt AS (SELECT * EXCLUDE (kind), regexp_replace(lower(replace(replace(label, 'İ', 'i'), 'I', 'ı')), '^[\\s.:()]+|[\\s.:()]+$', '', 'g') AS bare, regexp_extract(lower(trim(label)), '^(\\d{1,2})\\. ?(?:adım|step)(?:[^a-zçğıöşü0-9_]|$)', 1) AS step FROM act),
lv AS (SELECT *, CASE WHEN regexp_matches(bare, '^0*[1-9][0-9]{0,2}$') THEN 'digit' WHEN regexp_matches(bare, '^[a-zçğıöşü]$') THEN 'letter' WHEN step <> '' AND step::INT >= 1 THEN 'step' END AS kind,
  CASE WHEN regexp_matches(bare, '^0*[1-9][0-9]{0,2}$') THEN bare::DOUBLE WHEN regexp_matches(bare, '^[a-z]$') THEN (ascii(bare) - 96)::DOUBLE
    WHEN bare IN ('ç', 'ğ', 'ı', 'ö', 'ş', 'ü') THEN map {'ç': 3.5, 'ğ': 7.5, 'ı': 8.5, 'ö': 15.5, 'ş': 19.5, 'ü': 21.5}[bare]::DOUBLE WHEN step <> '' AND step::INT >= 1 THEN step::DOUBLE END AS value FROM lt)"""


@query(f"""WITH {views.SQL}, {_LABELS}, r AS (SELECT book_id, kind, value - lag(value) OVER (PARTITION BY book_id, page, kind ORDER BY value) AS s, value FROM (SELECT DISTINCT book_id, page, kind, value FROM lv)),
n AS (SELECT book_id, coalesce(bool_or(kind IS NOT NULL AND s > 0 AND s <= 1), false) AS has_run, count(value) AS n_labels FROM r GROUP BY 1)
SELECT k.book_id, coalesce(has_run, false) AS has_run, coalesce(n_labels, 0) AS n_labels, CASE WHEN has_run THEN 'strong' WHEN n.book_id IS NOT NULL THEN 'weak' ELSE 'none' END AS confidence
FROM (SELECT DISTINCT book_id FROM sh UNION SELECT book_id FROM n) k LEFT JOIN n USING (book_id)""")
def confidence_runs(spark, d) -> DataFrame:
    """How far each book's labels can be argued with: strong where two of one kind follow each other on a sheet, weak with any region, else none.

    A step is at most 1 (c and ç are half a step). Books are those of regions and of sheets.
    """
    a = views.activities(spark, d)
    v = a.select("book_id", "page", tx.label_value(F.col("label")).alias("l")).select("book_id", "page", "l.kind", "l.value").distinct()
    step = F.col("value") - F.lag("value").over(W.partitionBy("book_id", "page", "kind").orderBy("value"))
    follows = F.col("kind").isNotNull() & (F.col("s") > 0) & (F.col("s") <= 1)
    n = v.withColumn("s", step).groupBy("book_id").agg(F.bool_or(F.coalesce(follows, F.lit(False))).alias("has_run"), F.count("value").alias("n_labels"))
    every = views.sheets(spark, d).select("book_id").union(n.select("book_id")).distinct()
    return every.join(n.withColumn("_own", F.lit(True)), "book_id", "left").select(
        "book_id", F.coalesce("has_run", F.lit(False)).alias("has_run"), F.coalesce("n_labels", F.lit(0)).alias("n_labels"),
        F.when(F.col("has_run"), "strong").when(F.col("_own"), "weak").otherwise("none").alias("confidence"))


@query(f"""WITH RECURSIVE {views.SQL}, {_LABELS}, k AS (SELECT *, row_number() OVER (PARTITION BY book_id, page, col_no, kind ORDER BY -rect.y1, rect.x0, activity_key) AS k FROM lv WHERE label IS NOT NULL),
st AS (SELECT book_id, page, col_no, kind, 0::BIGINT AS k, []::STRUCT(v DOUBLE, s DOUBLE, z BIGINT)[] AS run FROM (SELECT DISTINCT book_id, page, col_no, kind FROM k WHERE kind IS NOT NULL)
  UNION ALL SELECT st.book_id, st.page, st.col_no, st.kind, k.k, list_append(run, (SELECT struct_pack(v := k.value, s := CASE WHEN coalesce(list_max(c), 0) > 1 THEN list_max(c) ELSE 1.0 END, z := CASE WHEN coalesce(list_max(c), 0) > 1 THEN run[list_position(c, list_max(c))].z + 1 ELSE 1 END)
      FROM (SELECT list_transform(run, lambda r: CASE WHEN r.v < k.value THEN r.s + 1 - 0.01 * greatest(k.value - r.v - 1, 0) WHEN k.value = 1 THEN r.s + 1 ELSE -1000 END) AS c)))
  FROM st JOIN k ON k.book_id = st.book_id AND k.page = st.page AND k.col_no IS NOT DISTINCT FROM st.col_no AND k.kind = st.kind AND k.k = st.k + 1),
fin AS (SELECT book_id, page, col_no, kind, arg_max(run, k) AS run FROM st GROUP BY ALL), top AS (SELECT *, list_max(list_transform(run, lambda r: r.s)) AS s FROM fin), at AS (SELECT *, run[list_position(list_transform(run, lambda r: r.s), s)] AS r FROM top),
b AS (SELECT book_id, page, col_no, kind, CASE WHEN s < 2 AND kind = 'letter' AND r.v <> 1 THEN 0 ELSE s END AS score, CASE WHEN s < 2 AND kind = 'letter' AND r.v <> 1 THEN 0 ELSE r.z END AS n FROM at),
g AS (SELECT DISTINCT book_id, page, col_no FROM k)
SELECT g.book_id, g.page, g.col_no, coalesce(arg_max(n, struct_pack(a := score, b := -CASE kind WHEN 'digit' THEN 1 WHEN 'letter' THEN 2 ELSE 3 END)), 0) AS n, coalesce(max(score), 0) AS score, coalesce(sum(n), 0)::BIGINT AS n_kept
FROM g LEFT JOIN b ON b.book_id = g.book_id AND b.page = g.page AND b.col_no IS NOT DISTINCT FROM g.col_no GROUP BY ALL""".replace(" at AS (SELECT", " en_ AS (SELECT").replace("FROM at),", "FROM en_),"))
def dp_longest_run(spark, d) -> DataFrame:
    """Best run of labels per column of a sheet, by the dynamic programme in each kind; ``n_kept`` counts the runs of all kinds."""
    a = views.activities(spark, d).where("label is not null").select(
        "book_id", "page", "col_no", F.struct((-F.col("rect.y1")).alias("y"), F.col("rect.x0").alias("x"), "activity_key").alias("at"), tx.label_value(F.col("label")).alias("l"))
    w = W.partitionBy("book_id", "page", "col_no").orderBy("at")
    ranked = a.select("book_id", "page", "col_no", F.row_number().over(w).alias("down"), F.col("l.kind").alias("kind"), F.col("l.value").alias("v"))
    return sequence.longest_label_run(ranked, ["book_id", "page", "col_no"], "down", "kind", "v")


@query("""WITH m AS (SELECT book_id, page, span_id, bbox.y1 AS y, bbox.x0 AS x FROM spans WHERE contains(lower(translate(text, 'İIıŞşĞğÇçÖöÜüÂâÎîÛû', 'iiissggccoouuaaiiuu')), 'olcu')),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page, y DESC, x, span_id) - 1 AS number, count(*) OVER (PARTITION BY book_id) AS total FROM m)
SELECT book_id, page, span_id, number, (number + 1) % total AS next_number, (number - 1 + total) % total AS prev_number FROM n""")
def search_match_numbering(spark, d) -> DataFrame:
    """Lines that hold a folded needle, numbered through the book from the top of each page, with wrapping neighbours."""
    m = table(spark, d, "spans").where(F.contains(tx.fold(F.col("text")), F.lit("olcu"))).select("book_id", "page", "span_id", F.col("bbox.y1").alias("y"), F.col("bbox.x0").alias("x"))
    total = m.groupBy("book_id").agg(F.count(F.lit(1)).alias("total"))
    n = numbered(m.withColumn("_down", -F.col("y")), ["book_id"], ["page", "_down", "x", "span_id"]).withColumn("number", F.col("number") - 1).join(total, "book_id")
    return n.select("book_id", "page", "span_id", "number", ((F.col("number") + 1) % F.col("total")).alias("next_number"), ((F.col("number") - 1 + F.col("total")) % F.col("total")).alias("prev_number"))


@query("""SELECT source, count(*) AS n FROM documents WHERE contains(lower(translate(text, 'İIıŞşĞğÇçÖöÜüÂâÎîÛû', 'iiissggccoouuaaiiuu')), 'sozluk') OR contains(lower(translate(text, 'İIıŞşĞğÇçÖöÜüÂâÎîÛû', 'iiissggccoouuaaiiuu')), 'gunluk') GROUP BY 1""")
def search_fold(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    f = tx.fold(F.col("text"))
    return t.where(F.contains(f, F.lit("sozluk")) | F.contains(f, F.lit("gunluk"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_FURNITURE = "book_id, page % 2 AS odd, round_even(rect.x0 / 3, 0) AS a, round_even(rect.y0 / 3, 0) AS b, round_even(rect.x1 / 3, 0) AS c, round_even(rect.y1 / 3, 0) AS e"


@query(f"""WITH {views.SQL}, k AS (SELECT {_FURNITURE}, page, activity_key FROM act WHERE kind = 'content'),
n AS (SELECT book_id, odd, a, b, c, e, count(DISTINCT page) AS pages FROM k GROUP BY ALL), t AS (SELECT book_id, max(page) AS last FROM sh GROUP BY 1)
SELECT k.book_id, k.page, k.activity_key, n.pages FROM k JOIN n USING (book_id, odd, a, b, c, e) LEFT JOIN t USING (book_id) WHERE n.pages >= greatest(4, floor(0.03 * coalesce(last, 0)))""")
def furniture_repeats(spark, d) -> DataFrame:
    """A book's furniture: content regions whose box, folded to three points, stands on many sheets of one parity (four, or 3 % of the sheets)."""
    pages = views.sheets(spark, d).groupBy("book_id").agg(F.max("page").alias("page_count"))
    content = views.activities(spark, d).where("kind = 'content'").select("book_id", "page", "activity_key", "rect")
    return layout.furniture(content, pages).select("book_id", "page", "activity_key", "pages")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS k, max(1 + l_quantity::BIGINT % 4) AS level FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, k::BIGINT AS k, level, (SELECT max(p.k) FROM l p WHERE p.l_orderkey = l.l_orderkey AND p.k < l.k AND p.level < l.level)::BIGINT AS parent FROM l""")
def toc_parents(spark, d) -> DataFrame:
    """Parent of each entry of a contents list: the latest one before of a smaller level."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("k")).agg(F.max(1 + F.col("l_quantity").cast("long") % 4).alias("level"))
    return sequence.toc_parents(t, "l_orderkey", "k", "level")


@query("""WITH u AS (SELECT user_id, event_id, ts, 100 + CAST(json_extract(props, '$.k') AS BIGINT) * 10 AS size FROM events),
r AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS held FROM u) SELECT user_id, event_id, size, held::BIGINT AS held FROM r WHERE held <= 5000 OR held = size""")
def budget_evict_oldest(spark, d) -> DataFrame:
    """What stays when the oldest go until the rest fits; the newest is never evicted."""
    u = table(spark, d, "events").select("user_id", "event_id", "ts", (100 + F.get_json_object("props", "$.k").cast("long") * 10).alias("size"))
    held = F.sum("size").over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(W.unboundedPreceding, 0))
    return u.withColumn("held", held).where((F.col("held") <= 5000) | (F.col("held") == F.col("size"))).select("user_id", "event_id", "size", "held")


@query("""WITH RECURSIVE u AS (SELECT user_id, event_id, 100 + CAST(json_extract(props, '$.k') AS BIGINT) * 10 AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0::BIGINT AS used, false AS won, 0::BIGINT AS event_id FROM u UNION ALL
  SELECT s.user_id, u.k, CASE WHEN s.used + u.size <= 5000 THEN s.used + u.size ELSE s.used END, s.used + u.size <= 5000, u.event_id FROM s JOIN u ON u.user_id = s.user_id AND u.k = s.k + 1)
SELECT user_id, event_id FROM s WHERE won""")
def budget_skip_fold(spark, d) -> DataFrame:
    """Newest first under a budget, skipping what does not fit."""
    u = table(spark, d, "events").select("user_id", "event_id", "ts", (100 + F.get_json_object("props", "$.k").cast("long") * 10).alias("size"))
    return sequence.budget_skip(u, ["user_id"], [F.desc("ts"), F.desc("event_id")], "size", 5000).select("user_id", "event_id")


@query(f"SELECT {joins._label_sql('title', 'sayfano')} AS label, count(*) AS n FROM (SELECT DISTINCT id, title, sayfano FROM publisher_oge) GROUP BY 1")
def entry_labels(spark, d) -> DataFrame:
    """Labels parsed from all titles, by the entry's page; the null label counts the titles without one."""
    t = table(spark, d, "publisher_oge").select("id", "title", "sayfano").distinct()
    return t.select("id", tx.entry_label(F.col("title"), F.col("sayfano")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query()
def xy_cut_leaves(spark, d) -> DataFrame:
    """Leaves of the recursive cut of each sheet's lines."""
    b = table(spark, d, "spans").where("bbox is not null").select("book_id", "page", F.col("span_id").alias("ord"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    return layout.xy_cut(b, ["book_id", "page"]).groupBy("book_id", "page", "leaf").agg(F.count(F.lit(1)).alias("n_lines"), F.min("x0").alias("x0"), F.max("y1").alias("y1"))
