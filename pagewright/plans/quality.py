"""Scores and label quality over the tables: page tallies, judged sheets, resolved verdicts, training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as geo
from pagewright.operators import labels, scoring, tally, views
from pagewright.plans import aggregates, joins
from pagewright.session import reliable, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Blocks of a sheet: its content regions, and spans that hold a label only.
_MARK = "^[(]?([0-9]{1,3}|[a-zçğıöşü])[.)]$"
_BLOCKS = f"""bl AS (SELECT book_id, page, 'solution' AS kind, activity_key AS ord, rect FROM act WHERE kind = 'content' UNION ALL SELECT book_id, page, 'marker', span_id::VARCHAR, bbox FROM spans WHERE regexp_matches(trim(text, ' '), '{_MARK}') AND bbox IS NOT NULL)"""
_BX = "bx AS (SELECT book_id, page, activity_key AS ord, label, rect, width, height FROM act JOIN sh USING (book_id, page) WHERE kind = 'activity')"
_IN = "greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0)"
_AREA = "(({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0))"
_CUTS = f"""ct AS (SELECT bx.book_id, bx.page, count(*) AS cut FROM bx JOIN bl ON bl.book_id = bx.book_id AND bl.page = bx.page AND bl.kind = 'solution'
  WHERE bl.rect.x0 >= -2 AND bl.rect.y0 >= -2 AND bl.rect.x1 <= width + 2 AND bl.rect.y1 <= height + 2 AND bl.rect.y1 - bl.rect.y0 <= 0.7 * height AND {_AREA.format(b='bl.rect')} > 0
    AND {_IN.format(a='bx.rect', b='bl.rect')} / {_AREA.format(b='bl.rect')} > 0.05 AND {_IN.format(a='bx.rect', b='bl.rect')} / {_AREA.format(b='bl.rect')} < 0.95 GROUP BY 1, 2)"""
_ICONS = "ic AS (SELECT DISTINCT et.book_id, et.page, entry_ord AS id, posx / 100 * width AS x, height - posy / 100 * height AS y FROM et JOIN fs USING (book_id, page) WHERE posx IS NOT NULL AND posy IS NOT NULL AND NOT isnan(posx) AND NOT isnan(posy) AND NOT (posx = 0 AND posy = 0))"


def _boxes(spark, d) -> DataFrame:
    return views.activities(spark, d).where("kind = 'activity'").select("book_id", "page", F.col("activity_key").alias("ord"), "label", "rect")


def _blocks(spark, d) -> DataFrame:
    content = views.activities(spark, d).where("kind = 'content'").select("book_id", "page", F.lit("solution").alias("kind"), F.col("activity_key").alias("ord"), "rect")
    marks = table(spark, d, "spans").where(F.trim("text").rlike(_MARK) & F.col("bbox").isNotNull()).select("book_id", "page", F.lit("marker").alias("kind"), F.col("span_id").cast("string").alias("ord"), F.col("bbox").alias("rect"))
    return content.unionByName(marks)


def _icons(spark, d) -> DataFrame:
    e, _ = joins._placed(spark, d)
    px, py = F.nanvl("posx", F.lit(None).cast("double")), F.nanvl("posy", F.lit(None).cast("double"))
    own = e.where(px.isNotNull() & py.isNotNull() & views.has_position()).join(views.sheets(spark, d).select("book_id", "page", "width", "height"), ["book_id", "page"])
    return own.select("book_id", "page", F.col("entry_ord").alias("id"), (F.col("posx") / 100 * F.col("width")).alias("x"), (F.col("height") - F.col("posy") / 100 * F.col("height")).alias("y")).distinct()


def _sums(prefix: str = "") -> str:
    return ", ".join(f"sum({prefix}{c})::BIGINT AS {c}" for c in scoring.COUNTERS)


@query(f"""WITH {joins._PLACED}, {_BLOCKS}, {_BX}, {_CUTS},
it AS (SELECT activity_key, count(DISTINCT item_key) AS n FROM item GROUP BY 1),
hd AS (SELECT bx.book_id, bx.page, count(*) AS regions, sum(coalesce(n, 0)) AS questions, count(*) FILTER (WHERE coalesce(n, 0) = 0) AS empty_regions, count(*) FILTER (WHERE rect.y1 - rect.y0 > 0.7 * height) AS tall,
  count(*) FILTER (WHERE rect.y1 - rect.y0 < 6 OR rect.x1 - rect.x0 < 6) AS slivers FROM bx LEFT JOIN it ON it.activity_key = bx.ord GROUP BY 1, 2),
ov AS (SELECT a.book_id, a.page, count(*) AS overlaps FROM bx a JOIN bx b ON a.book_id = b.book_id AND a.page = b.page AND a.ord < b.ord WHERE {_IN.format(a='a.rect', b='b.rect')} > 1 GROUP BY 1, 2),
bs AS (SELECT bl.*, bl.rect.x0 >= -2 AND bl.rect.y0 >= -2 AND bl.rect.x1 <= width + 2 AND bl.rect.y1 <= height + 2 AS on_sheet FROM bl JOIN sh USING (book_id, page)),
sn AS (SELECT book_id, page, count(*) FILTER (WHERE kind = 'marker') AS markers, count(*) FILTER (WHERE kind = 'solution' AND on_sheet) AS solutions_total, count(*) FILTER (WHERE kind = 'solution' AND NOT on_sheet) AS off_sheet_solutions FROM bs GROUP BY 1, 2),
gt AS (SELECT book_id, page, count(*) FILTER (WHERE kind = 'marker') AS markers_in_region, count(*) FILTER (WHERE kind = 'solution') AS solutions_covered FROM (SELECT DISTINCT bs.book_id, bs.page, bs.kind, bs.ord FROM bs JOIN bx ON bx.book_id = bs.book_id AND bx.page = bs.page
  WHERE CASE WHEN kind = 'marker' THEN {_IN.format(a='bx.rect', b='bs.rect')} > 0 ELSE on_sheet AND {_IN.format(a='bx.rect', b='bs.rect')} >= 0.5 * {_AREA.format(b='bs.rect')} END) GROUP BY 1, 2),
og AS (SELECT book_id, page, count(*) AS n FROM et GROUP BY 1, 2),
pg AS (SELECT sh.book_id, sh.page, coalesce(regions, 0) AS regions, coalesce(regions, 0) AS parts, coalesce(questions, 0) AS questions, coalesce(empty_regions, 0) AS empty_regions, (coalesce(regions, 0) > 0)::INT AS pages_with_regions,
  coalesce(markers, 0) AS markers, coalesce(markers_in_region, 0) AS markers_in_region, 0 AS panels_cut, coalesce(cut, 0) AS solutions_cut, coalesce(solutions_covered, 0) AS solutions_covered, coalesce(solutions_total, 0) AS solutions_total, 0 AS panels_total,
  coalesce(off_sheet_solutions, 0) AS off_sheet_solutions, coalesce(tall, 0) AS tall, coalesce(slivers, 0) AS slivers, coalesce("overlaps", 0) AS "overlaps", 0 AS anchored, coalesce(og.n, 0) AS oges_seen, CASE WHEN coalesce(regions, 0) = 0 THEN coalesce(og.n, 0) ELSE 0 END AS oges_on_blank_pages
  FROM sh LEFT JOIN hd USING (book_id, page) LEFT JOIN ov USING (book_id, page) LEFT JOIN ct USING (book_id, page) LEFT JOIN sn USING (book_id, page) LEFT JOIN gt USING (book_id, page) LEFT JOIN og USING (book_id, page))
SELECT book_id, count(*) AS pages, {_sums().replace('sum(overlaps)', 'sum("overlaps")').replace('AS overlaps', 'AS "overlaps"')} FROM pg GROUP BY 1""")
def tally_counters(spark, d) -> DataFrame:
    """All counters of each book: page tallies merged."""
    return scoring.merged(_tallies(spark, d)).select("book_id", "pages", *scoring.COUNTERS)


def _tallies(spark, d) -> DataFrame:
    boxes = _boxes(spark, d)
    items = table(spark, d, "item").groupBy(F.col("activity_key").alias("ord")).agg(F.countDistinct("item_key").alias("n_items"))
    regions = boxes.join(items, "ord", "left").select("book_id", "page", F.col("ord").alias("id"), "n_items", F.lit(False).alias("anchored"), F.lit(False).alias("bound"))
    entries, _ = joins._placed(spark, d)
    return scoring.page_tallies(views.sheets(spark, d), regions, boxes.withColumn("anchored", F.lit(False)), _blocks(spark, d), entries)


@query(f"""WITH t AS ({ORACLES['tally_counters']}), f AS ({aggregates._FILED} SELECT book_id, count(*) AS oges, count(*) FILTER (WHERE bucket = 'ok') AS matched FROM b GROUP BY 1)
SELECT t.book_id, pages, regions, coalesce(oges, 0) AS oges, coalesce(matched, 0) AS matched, round(matched / nullif(oges, 0), 3) AS match_rate, coalesce(round(1 - pages_with_regions / nullif(pages, 0), 3), 0) AS blank_page_share,
  coalesce(round(empty_regions / nullif(regions, 0), 3), 0) AS empty_region_share, markers - markers_in_region AS markers_outside, round(solutions_covered / nullif(solutions_total, 0), 3) AS solution_coverage FROM t LEFT JOIN f USING (book_id)""")
def score_rows(spark, d) -> DataFrame:
    """The row of each book: shares of its counters and its entries by bucket."""
    filed = aggregates._filed(spark, d).select("book_id", "entry_ord", "bucket")
    rows = scoring.book_rows(scoring.merged(_tallies(spark, d)), filed)
    return rows.select("book_id", "pages", "regions", "oges", F.col("ok").alias("matched"), "match_rate", "blank_page_share", "empty_region_share", "markers_outside", "solution_coverage")


@query(f"""{joins._GREEDY}, f AS (SELECT abs(posy - t) AS v FROM links JOIN pr0 USING (book_id, page, entry_ord, region_ord) WHERE NOT isnan(posy)), x AS (SELECT list_sort(list(v)) AS xs FROM f)
SELECT round(xs[least(len(xs) - 1, floor(len(xs) * 0.5)::BIGINT) + 1], 2) AS median, round(xs[least(len(xs) - 1, floor(len(xs) * 0.75)::BIGINT) + 1], 2) AS p75, round(xs[least(len(xs) - 1, floor(len(xs) * 0.9)::BIGINT) + 1], 2) AS p90,
  round(xs[least(len(xs) - 1, floor(len(xs) * 0.99)::BIGINT) + 1], 2) AS p99, round(xs[len(xs)], 2) AS top FROM x""")
def drift_quantiles(spark, d) -> DataFrame:
    """Nearest-rank quantiles of the distance between linked entries and their region's top, in percent."""
    pairs = reliable(joins.matching.gated_pairs(*joins._placed(spark, d), ["book_id", "page"]))
    links = joins._links(pairs)
    drift = pairs.select("book_id", "page", "entry_ord", "region_ord", F.abs(F.col("posy") - F.col("top")).alias("v")).join(links, ["book_id", "page", "entry_ord", "region_ord"]).withColumn("all", F.lit(1))
    q = tally.nearest_rank(drift, ["all"], "v", {"median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99, "top": 1.0})
    return q.select(*[F.round(c, 2).alias(c) for c in ("median", "p75", "p90", "p99", "top")])


_ALL = "book_id, page, boxes, cut, sliver, tall, overlap_major, overlap_minor, icons, miss"


@query(f"""WITH {joins._PLACED}, {_BLOCKS}, {_BX}, {_CUTS}, {_ICONS},
b AS (SELECT book_id, page, count(*) AS boxes, count(*) FILTER (WHERE rect.y1 - rect.y0 < 6 OR rect.x1 - rect.x0 < 6) AS sliver, count(*) FILTER (WHERE rect.y1 - rect.y0 > 0.7 * height) AS tall FROM bx GROUP BY 1, 2),
o AS (SELECT a.book_id, a.page, count(*) FILTER (WHERE NOT thin) AS overlap_major, count(*) FILTER (WHERE thin) AS overlap_minor FROM (SELECT a.book_id, a.page, {_IN.format(a='a.rect', b='b.rect')} AS s,
  least(least(a.rect.x1, b.rect.x1) - greatest(a.rect.x0, b.rect.x0), least(a.rect.y1, b.rect.y1) - greatest(a.rect.y0, b.rect.y0)) < 6 AS thin FROM bx a JOIN bx b ON a.book_id = b.book_id AND a.page = b.page AND a.ord < b.ord) a WHERE s > 1 GROUP BY 1, 2),
i AS (SELECT ic.book_id, ic.page, count(*) AS icons, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.book_id = ic.book_id AND bx.page = ic.page AND x BETWEEN rect.x0 - greatest(16, 0.1 * width) AND rect.x1 + greatest(16, 0.1 * width) AND y BETWEEN rect.y0 - 16 AND rect.y1 + 16)) AS miss FROM ic GROUP BY 1, 2),
j AS (SELECT sh.book_id, sh.page, coalesce(boxes, 0) AS boxes, coalesce(cut, 0) AS cut, coalesce(sliver, 0) AS sliver, coalesce(tall, 0) AS tall, coalesce(overlap_major, 0) AS overlap_major, coalesce(overlap_minor, 0) AS overlap_minor, coalesce(icons, 0) AS icons, coalesce(miss, 0) AS miss
  FROM sh LEFT JOIN b USING (book_id, page) LEFT JOIN ct USING (book_id, page) LEFT JOIN o USING (book_id, page) LEFT JOIN i USING (book_id, page))
SELECT {_ALL}, (sliver = 0 AND overlap_major = 0 AND miss = 0) AS passes FROM j""")
def judge_pages(spark, d) -> DataFrame:
    """Every sheet's regions judged as labels: counters, missed icons, and whether they pass."""
    return _judged(spark, d).select(*_ALL.split(", "), "passes")


def _judged(spark, d) -> DataFrame:
    return labels.judged(views.sheets(spark, d).select("book_id", "page", "width", "height"), _boxes(spark, d), _icons(spark, d), _blocks(spark, d))


# First labels are runs 1, repeated ones runs 2; what was never scored could not be had. A run passes without violations.
_RUNS = """s AS (SELECT DISTINCT * EXCLUDE (row_id) FROM book_score), p AS (SELECT book_id, run_no AS page, bool_and(panels_cut + solutions_cut + "overlaps" = 0) AS passes FROM s WHERE run_no % 2 = 1 AND regions > 0 GROUP BY 1, 2),
a AS (SELECT book_id, run_no - 1 AS page, bool_and(panels_cut + solutions_cut + "overlaps" < 20) AS passes FROM s WHERE run_no % 2 = 0 AND regions > 0 GROUP BY 1, 2), f AS (SELECT DISTINCT book_id, run_no AS page FROM s WHERE run_no % 2 = 1 AND coalesce(regions, 0) = 0),
g AS (SELECT DISTINCT book_id, run_no - 1 AS page FROM s WHERE run_no % 2 = 0 AND coalesce(regions, 0) = 0)"""


@query(f"""WITH {_RUNS}, k AS (SELECT book_id, page FROM p UNION SELECT book_id, page FROM f),
j AS (SELECT k.book_id, k.page, coalesce(p.passes, false) AS first, p.passes IS NOT NULL AS had, coalesce(a.passes, false) AS second, a.passes IS NOT NULL OR g.book_id IS NOT NULL AS again, f.book_id IS NOT NULL AS lost
  FROM k LEFT JOIN p USING (book_id, page) LEFT JOIN a USING (book_id, page) LEFT JOIN f USING (book_id, page) LEFT JOIN g USING (book_id, page))
SELECT book_id, page::BIGINT AS page, CASE WHEN first OR second THEN 'trusted' WHEN again THEN 'rejected' ELSE 're-ask' END AS verdict, CASE WHEN NOT first AND (second OR again) THEN 'reask' ELSE 'primary' END AS source, lost AND NOT had AS request_failed FROM j""")
def reask_resolution(spark, d) -> DataFrame:
    """What became of each thing asked: first answers, repeated ones, and those that could not be had."""
    s = table(spark, d, "book_score").drop("row_id").distinct().withColumn("bad", F.col("panels_cut") + F.col("solutions_cut") + F.col("overlaps"))
    odd, had = F.col("run_no") % 2 == 1, F.col("regions") > 0
    keys = ["book_id", "page"]
    own = s.withColumn("page", F.when(odd, F.col("run_no")).otherwise(F.col("run_no") - 1).cast("long"))
    p = own.where(odd & had).groupBy(*keys).agg(F.bool_and(F.col("bad") == 0).alias("passes"))
    a = own.where(~odd & had).groupBy(*keys).agg(F.bool_and(F.col("bad") < 20).alias("passes"))
    none = F.coalesce("regions", F.lit(0)) == 0
    return labels.resolved(p, own.where(odd & none), a, own.where(~odd & none))


@query(f"""WITH {views.SQL}, k AS (SELECT id, book_id, page, width, height, printed_page FROM sh JOIN (SELECT DISTINCT book_id AS b, book_id AS id FROM sh) ON b = book_id),
bk AS (SELECT book_id, min(coalesce(template, 'subject')) AS template, bool_or(lower(trim(split)) = 'test') AS held_out FROM book_score GROUP BY 1), lb AS (SELECT DISTINCT book_id FROM act WHERE kind = 'activity'),
c AS (SELECT bk.*, lb.book_id IS NOT NULL AS labelled FROM bk LEFT JOIN lb USING (book_id)),
v AS (SELECT template, arg_min(book_id, md5('1|' || book_id) || book_id) AS book_id FROM c WHERE NOT coalesce(held_out, false) AND labelled GROUP BY 1 HAVING count(*) > 1)
SELECT c.book_id, c.template, CASE WHEN coalesce(held_out, false) THEN 'heldout' WHEN v.book_id IS NOT NULL THEN 'valid' ELSE 'train' END AS split FROM c LEFT JOIN v ON v.book_id = c.book_id""")
def split_assignment(spark, d) -> DataFrame:
    """Train, validation and held-out books: one labelled training book of each template validates."""
    return _splits(spark, d).select("book_id", "template", "split")


def _splits(spark, d) -> DataFrame:
    b = table(spark, d, "book_score").groupBy("book_id").agg(F.min(F.coalesce("template", F.lit("subject"))).alias("template"), F.coalesce(F.bool_or(F.lower(F.trim("split")) == "test"), F.lit(False)).alias("held_out"))
    has = views.activities(spark, d).where("kind = 'activity'").select("book_id").distinct().withColumn("labelled", F.lit(True))
    return labels.split_books(b.join(has, "book_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False))))


def _coco(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sheets with activities as labels in pixels of 2 a point (y downwards); sheets that were withdrawn have no rendered page."""
    r = F.col("rect")
    px = F.array(2 * r["x0"], 2 * (F.col("height") - r["y1"]), 2 * r["x1"], 2 * (F.col("height") - r["y0"]))
    sheets = views.sheets(spark, d)
    own = _boxes(spark, d).join(sheets, ["book_id", "page"]).groupBy("book_id", "page", F.round(2 * F.col("width")).cast("int").alias("width_px"), F.round(2 * F.col("height")).cast("int").alias("height_px")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", px.alias("px")))), lambda x: x["px"]).alias("boxes"))  # one sheet's boxes
    live = table(spark, d, "sheets").where("deleted_at is null").select("book_id", "page").distinct()
    return labels.coco(own, _splits(spark, d), live)


_COCO = f"""WITH {views.SQL}, bk AS (SELECT book_id, min(coalesce(template, 'subject')) AS template, coalesce(bool_or(lower(trim(split)) = 'test'), false) AS held_out FROM book_score GROUP BY 1), lb AS (SELECT DISTINCT book_id FROM act WHERE kind = 'activity'),
v AS (SELECT arg_min(book_id, md5('1|' || book_id) || book_id) AS book_id FROM bk SEMI JOIN lb USING (book_id) WHERE NOT held_out GROUP BY template HAVING count(*) > 1),
sp AS (SELECT bk.book_id, CASE WHEN held_out THEN 'heldout' WHEN v.book_id IS NOT NULL THEN 'valid' ELSE 'train' END AS split FROM bk LEFT JOIN v ON v.book_id = bk.book_id),
raw AS (SELECT a.book_id, a.page, activity_key AS ord, round(2 * width)::INT AS w, round(2 * height)::INT AS h, 2 * rect.x0 AS p0, 2 * (height - rect.y1) AS p1, 2 * rect.x1 AS p2, 2 * (height - rect.y0) AS p3 FROM act a JOIN sh USING (book_id, page) WHERE kind = 'activity'),
cl AS (SELECT *, greatest(0, least(p0, p2)) AS x0, least(w, greatest(p0, p2)) AS x1, greatest(0, least(p1, p3)) AS y0, least(h, greatest(p1, p3)) AS y1 FROM raw),
rd AS (SELECT *, round_even(x1 - x0, 1) AS bw, round_even(y1 - y0, 1) AS bh FROM cl),
pgs AS (SELECT rd.book_id, rd.page, any_value(sp.split) AS split, count(*) AS n, CASE WHEN any_value(sp.split) IS NULL THEN 'book not in the selection' WHEN NOT EXISTS (SELECT 1 FROM sheets s WHERE s.book_id = rd.book_id AND s.page = rd.page AND s.deleted_at IS NULL) THEN 'no rendered page' WHEN bool_or(bw <= 2 OR bh <= 2) THEN 'a box of 2 px or less' END AS why
  FROM rd LEFT JOIN sp USING (book_id) GROUP BY rd.book_id, rd.page),
im AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY book_id, page) - 1 AS id FROM pgs WHERE why IS NULL)"""


@query(f"{_COCO} SELECT split, id, book_id || '_' || lpad(page::VARCHAR, 4, '0') || '.jpg' AS file_name, book_id, page, n AS n_boxes FROM im")
def coco_images(spark, d) -> DataFrame:
    """Images of the training set, with dense ids within each split."""
    return _coco(spark, d)[0].select("split", "id", "file_name", "book_id", "page", F.col("n_boxes").cast("long").alias("n_boxes"))


@query(f"{_COCO} SELECT im.split, row_number() OVER (PARTITION BY im.split ORDER BY im.id, rd.ord) - 1 AS id, im.id AS image_id, bw, bh FROM im JOIN rd ON rd.book_id = im.book_id AND rd.page = im.page")
def coco_annotations(spark, d) -> DataFrame:
    """Annotations of the training set, clamped to the image."""
    return _coco(spark, d)[1].select("split", "id", "image_id", F.col("bbox")[2].alias("bw"), F.col("bbox")[3].alias("bh"))


@query(f"{_COCO} SELECT why, count(*) AS n FROM pgs WHERE why IS NOT NULL GROUP BY 1")
def coco_dropped(spark, d) -> DataFrame:
    """Pages left out of the training set, by reason."""
    return _coco(spark, d)[2].groupBy("why").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_COCO} SELECT split, count(DISTINCT book_id) AS books, count(*) AS pages, sum(n)::BIGINT AS boxes, count(*) FILTER (WHERE n = 0) AS empty FROM im GROUP BY 1")
def coco_split_stats(spark, d) -> DataFrame:
    s = labels.split_stats(_coco(spark, d)[0])
    return s.select("split", "books", "pages", F.col("boxes").cast("long").alias("boxes"), "empty")


@query(f"""WITH {joins._PLACED}, {_ICONS}, {_BX}, near AS (SELECT ic.book_id, ic.page, ic.id, bx.ord, (rect.x1 - rect.x0) * (rect.y1 - rect.y0) AS area,
  100 * abs(y - rect.y1) / height + 50 * greatest(rect.x0 - x, x - rect.x1, 0) / width AS cost, nullif(es.e_label, '') AS el, nullif(lower(trim(bx.label)), '') AS rl
  FROM ic JOIN bx ON bx.book_id = ic.book_id AND bx.page = ic.page JOIN (SELECT DISTINCT entry_ord, book_id, e_label FROM es) es ON es.entry_ord = ic.id AND es.book_id = ic.book_id
  WHERE x BETWEEN rect.x0 - 0.06 * width AND rect.x1 + 0.06 * width AND y BETWEEN rect.y0 - 6 AND rect.y1 + 24),
w AS (SELECT book_id, page, id, arg_min(struct_pack(ord := ord, cost := cost), struct_pack(a := area, o := ord)) AS w FROM near WHERE el IS NULL OR rl IS NULL OR el = rl GROUP BY 1, 2, 3)
SELECT book_id, page, w.ord AS ord, arg_min(id, struct_pack(c := w.cost, i := id)) AS id FROM w GROUP BY 1, 2, 3""")
def icon_binding(spark, d) -> DataFrame:
    """Icons bound to the tightest region they stand at, each region to the cheapest of its rivals."""
    e, _ = joins._placed(spark, d)
    icons = _icons(spark, d).join(e.select("book_id", "page", F.col("entry_ord").alias("id"), F.col("e_label").alias("label")).distinct(), ["book_id", "page", "id"])
    return labels.bound(icons, _boxes(spark, d), views.sheets(spark, d))


@query(f"""WITH {joins._PLACED}, {_ICONS}, {_BX} SELECT ic.book_id, ic.page, ic.id, arg_min(bx.ord, struct_pack(a := greatest(1, (rect.y1 - rect.y0) * (rect.x1 - rect.x0)), o := bx.ord)) AS owner FROM ic JOIN bx ON bx.book_id = ic.book_id AND bx.page = ic.page
WHERE y BETWEEN rect.y0 - 6 AND rect.y1 + 24 AND x BETWEEN rect.x0 - 24 AND rect.x1 + 24 GROUP BY 1, 2, 3""")
def band_owners(spark, d) -> DataFrame:
    """The region in whose band each icon stands."""
    r = F.col("rect")
    bands = _boxes(spark, d).select("book_id", "page", "ord", F.col("ord").alias("owner"), r["x0"].alias("x0"), r["x1"].alias("x1"), r["y0"].alias("bottom"), r["y1"].alias("top"))
    return labels.band_owner(_icons(spark, d), bands)


_TOTALS = "100 * coalesce((panels_cut + solutions_cut) / nullif(regions, 0), 0) + 200 * coalesce(\"overlaps\" / nullif(regions, 0), 0) + 40 * coalesce(tall / nullif(regions, 0), 0) + 40 * coalesce(slivers / nullif(regions, 0), 0) + CASE WHEN oges > 0 THEN 20 * (oges - matched) / oges ELSE 0 END - coalesce(pages_with_regions / nullif(pages, 0), 0)"


@query(f"""WITH s AS (SELECT DISTINCT * EXCLUDE (row_id) FROM book_score) SELECT count(*) AS books, sum(regions)::BIGINT AS regions, sum(matched)::BIGINT AS matched, round(avg({_TOTALS}), 6) AS loss, round(sum(panels_cut + solutions_cut) / nullif(sum(regions), 0), 6) AS cut_rate,
  round(sum(matched) / nullif(sum(oges), 0), 6) AS match_rate, round(sum(pages_with_regions) / nullif(sum(pages), 0), 6) AS coverage FROM s""")
def evaluation_totals(spark, d) -> DataFrame:
    """Totals of all score rows and the mean loss."""
    t = scoring.evaluation(tally.rates(aggregates._scores(spark, d)))
    return t.select("books", "regions", "matched", *[F.round(c, 6).alias(c) for c in ("loss", "cut_rate", "match_rate", "coverage")])


@query("""WITH s AS (SELECT DISTINCT * EXCLUDE (row_id) FROM book_score), f AS (SELECT book_id, min(run_no) AS a, max(run_no) AS b FROM s GROUP BY 1),
o AS (SELECT s.book_id, max(regions) AS regions FROM s JOIN f ON f.book_id = s.book_id AND s.run_no = f.a GROUP BY 1), n AS (SELECT s.book_id, max(regions) AS regions FROM s JOIN f ON f.book_id = s.book_id AND s.run_no = f.b AND f.b > f.a GROUP BY 1)
SELECT book_id, n.regions AS regions, o.regions AS regions_before, n.regions - o.regions AS regions_delta FROM n FULL JOIN o USING (book_id)""")
def baseline_comparison(spark, d) -> DataFrame:
    """Each book's last run beside its first."""
    s = aggregates._scores(spark, d)
    f = s.groupBy("book_id").agg(F.min("run_no").alias("a"), F.max("run_no").alias("b"))
    j = s.join(f, "book_id")
    first = j.where("run_no = a").groupBy("book_id").agg(F.max("regions").alias("regions"))
    last = j.where("run_no = b and b > a").groupBy("book_id").agg(F.max("regions").alias("regions"))
    return scoring.compared(last, first, ["book_id"], ["regions"])


@query(f"""{ORACLES['judge_pages'].replace(f'SELECT {_ALL}, (sliver = 0 AND overlap_major = 0 AND miss = 0) AS passes FROM j', '')}, v AS (SELECT *, (sliver = 0 AND overlap_major = 0 AND miss = 0) AS passes FROM j)
SELECT book_id, count(*) AS pages, count(*) FILTER (WHERE passes) AS trusted, count(*) FILTER (WHERE NOT passes) AS re_ask, count(*) FILTER (WHERE passes AND boxes = 0) AS empty, count(*) FILTER (WHERE icons > 0) AS manifest_pages,
  count(*) FILTER (WHERE icons > 0 AND passes) AS manifest_trusted, sum(boxes)::BIGINT AS boxes, sum(miss)::BIGINT AS miss FROM v GROUP BY ROLLUP (book_id)""")
def qa_summary(spark, d) -> DataFrame:
    """Judged sheets per book and in total."""
    v = _judged(spark, d).withColumn("verdict", F.when(F.col("passes"), "trusted").otherwise("re-ask"))
    return labels.summary(v).select("book_id", "pages", "trusted", "re_ask", "empty", "manifest_pages", "manifest_trusted", "boxes", "miss")


@query(f"""WITH {views.SQL}, i AS (SELECT DISTINCT i.item_key, i.rect AS ri, a.activity_key, a.rect AS ra, a.book_id, a.page FROM item i JOIN act a USING (activity_key) WHERE i.rect IS NOT NULL), s AS (SELECT span_id, book_id, page, bbox FROM spans WHERE bbox IS NOT NULL),
h AS (SELECT item_key, activity_key, span_id, coalesce({_IN.format(a='ri', b='bbox')} >= 0.5 * nullif({_AREA.format(b='bbox')}, 0), false) AS by_item, coalesce({_IN.format(a='ra', b='bbox')} >= 0.5 * nullif({_AREA.format(b='bbox')}, 0), false) AS by_region FROM i JOIN s USING (book_id, page))
SELECT item_key, activity_key, round(CASE WHEN count(*) FILTER (WHERE by_item OR by_region) = 0 THEN 1 ELSE count(*) FILTER (WHERE by_item AND by_region) / count(*) FILTER (WHERE by_item OR by_region) END, 6) AS jaccard FROM h GROUP BY 1, 2""")
def held_lines_jaccard(spark, d) -> DataFrame:
    """How much of the lines that an item's or its region's box holds (half of a line or more) both hold; 1 where neither holds any."""
    act = views.activities(spark, d).select("activity_key", "book_id", "page", F.col("rect").alias("ra"))
    i = table(spark, d, "item").where("rect is not null").select("item_key", "activity_key", F.col("rect").alias("ri")).distinct().join(act, "activity_key")
    b = F.col("bbox")
    s = table(spark, d, "spans").where("bbox is not null").select("span_id", "book_id", "page", "bbox")
    half = 0.5 * F.nullif((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]), F.lit(0.0))
    own, whole = (F.coalesce(geo.overlap(F.col(c), b) >= half, F.lit(False)) for c in ("ri", "ra"))
    n = i.join(s, ["book_id", "page"]).groupBy("item_key", "activity_key", "ri", "ra").agg(F.count_if(own & whole).alias("both"), F.count_if(own | whole).alias("any"))
    n = n.groupBy("item_key", "activity_key").agg(F.sum("both").alias("both"), F.sum("any").alias("any"))
    return n.select("item_key", "activity_key", F.round(F.when(F.col("any") == 0, F.lit(1.0)).otherwise(F.col("both") / F.col("any")), 6).alias("jaccard"))
