"""Geometric and keyed joins, assignments and detection matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as geo
from pagewright.functions import text as tx
from pagewright.operators import detection, graph, matching, tally, views
from pagewright.operators.prefix import numbered
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


def _placed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Interactive entries by each sheet of their printed page, and regions by sheet, in percent of the sheet."""
    s = views.sheets(spark, d)
    s = s.join(tally.folio(s), ["book_id", "page"]).where("printed is not null")
    a = views.activities(spark, d).where("kind = 'activity'").join(s, ["book_id", "page"])
    left, top, right, bottom = geo.percent_view(F.col("rect"), F.col("width"), F.col("height"))
    regions = a.select("book_id", "page", F.col("activity_key").alias("region_ord"), tx.tidy_label(F.col("label")).alias("r_label"), left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"), F.lit(False).alias("bound"))
    own = views.entries(spark, d).where(views.interactive()).select(
        "book_id", F.col("sayfano").alias("printed"), F.col("id").alias("entry_ord"), tx.entry_label(F.col("title"), F.col("sayfano")).alias("e_label"), "x", "y", "posx", "posy")
    return own.join(s.select("book_id", "page", "printed"), ["book_id", "printed"]), regions


_SHEET = ["book_id", "page"]
_LOW = "lower(replace({}, 'İ', 'i̇'))"
_STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _label_sql(title: str, page: str) -> str:
    """The label of a title in SQL: the same steps as the reference rule of ``text.entry_label``."""
    def paged(t: str, n: str, marks: str) -> str:
        own = f"CASE WHEN {page} > 0 THEN '^0*' || ({n})::VARCHAR || '\\s*[{marks}]?\\s*' ELSE '^' END"
        return _STRIPPED.format(f"regexp_replace({t}, {own}, '')")

    t = paged(paged(_STRIPPED.format(_LOW.format(title)), page, "\\-/\\\\.:"), f"{page} - 1", "\\-/\\\\.:_")
    t = _STRIPPED.format(f"regexp_replace({t}, '^\\d{{1,4}}\\s*[\\-/:]\\s*', '')")
    t = f"regexp_replace({t}, '(^|[^\\pL\\pN_])ed\\s*\\d*(?:[\\s._\\-]*[\\s.\\-]ed\\s*\\d*)*[\\s._\\-]*$', '\\1')"
    t = f"regexp_replace({t}, '[\\s._\\-]+$', '')"
    t = f"regexp_replace({t}, '^(?:(\\d{{1,2}})\\s*\\.?\\s*soru(?:.|\\n)*|([a-zçğıöşü]|\\d{{1,2}})|\\d{{1,4}}\\s*[/\\-.:]?\\s*([a-zçğıöşü]))$', '\\1\\2\\3')"
    return f"nullif(regexp_extract({t}, '^([a-zçğıöşü]|\\d{{1,2}})$', 1), '')"


_FOLIO = f"""{views.SQL},
fv AS (SELECT book_id, page - printed_page AS off, count(*) AS n, min(page) AS first FROM sh WHERE printed_page IS NOT NULL GROUP BY 1, 2),
fb AS (SELECT book_id, off FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, abs(off), first) AS k FROM fv) WHERE k = 1),
fs AS (SELECT book_id, page, width, height, coalesce(off, 0) AS book_offset, coalesce(printed_page, CASE WHEN page - coalesce(off, 0) >= 0 THEN page - coalesce(off, 0) END) AS printed FROM sh LEFT JOIN fb USING (book_id))"""
_PLACED = f"""{_FOLIO},
rg AS (SELECT book_id, page, activity_key AS region_ord, regexp_replace({_LOW.format('label')}, '^[\\s.:()]+|[\\s.:()]+$', '', 'g') AS r_label, rect, height,
  100 * rect.x0 / width AS l, 100 * (1 - rect.y1 / height) AS t, 100 * rect.x1 / width AS r, 100 * (1 - rect.y0 / height) AS b FROM act JOIN fs USING (book_id, page) WHERE kind = 'activity' AND printed IS NOT NULL),
es AS (SELECT id AS entry_ord, book_id, sayfano AS printed, {_label_sql('title', 'sayfano')} AS e_label, x, y, posx, posy FROM en WHERE ogeturu = 1 AND length(data) > 0 AND sayfaustuoge AND sayfano <> 0),
et AS (SELECT es.*, fs.page FROM es JOIN fs ON fs.book_id = es.book_id AND fs.printed = es.printed),
pr0 AS (SELECT et.*, region_ord, nullif(r_label, '') AS rl, nullif(e_label, '') AS el, l, t, r, b, abs(y - t) AS drift, greatest(l - x, x - r, 0) AS reach FROM et JOIN rg USING (book_id, page)),
pr AS (SELECT *, drift + 0.5 * reach AS cost, CASE WHEN y IS NULL THEN 'no-position' WHEN el IS NOT NULL AND rl IS NOT NULL AND el <> rl THEN 'label-mismatch'
  WHEN reach > 20 AND NOT (el IS NOT NULL AND rl IS NOT NULL) THEN 'wrong-side'
  WHEN drift > CASE WHEN el IS NOT NULL AND rl IS NOT NULL THEN 10 ELSE 5 END AND NOT (reach = 0 AND y BETWEEN t AND b) THEN 'drift' END AS reason FROM pr0)"""


@query(f"WITH {_PLACED} SELECT coalesce(reason, 'candidate') AS reason, count(*) AS n, round(avg(cost), 4) AS mean_cost FROM pr GROUP BY 1")
def region_entry_pairs(spark, d) -> DataFrame:
    """Pairs of entries and regions of a sheet by the gate that stops them."""
    p = matching.gated_pairs(*_placed(spark, d), _SHEET)
    return p.groupBy(F.coalesce("reason", F.lit("candidate")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cost"), 4).alias("mean_cost"))


@query(f"""WITH {_PLACED} SELECT book_id, page, entry_ord, candidates, CASE WHEN candidates > 0 THEN 'contested' ELSE gate END AS gate, n_reasons FROM (
  SELECT book_id, page, entry_ord, count(*) FILTER (WHERE reason IS NULL) AS candidates, count(DISTINCT reason) AS n_reasons,
    arg_min(reason, CASE reason WHEN 'no-position' THEN 1 WHEN 'confidence-gated' THEN 2 WHEN 'label-mismatch' THEN 3 WHEN 'drift' THEN 4 ELSE 5 END) FILTER (WHERE reason IS NOT NULL) AS gate FROM pr GROUP BY 1, 2, 3)""")
def link_explain(spark, d) -> DataFrame:
    """What each entry met on its sheet: candidates, the number of reasons, and the gate that counts."""
    e = matching.explained(matching.gated_pairs(*_placed(spark, d), _SHEET), _SHEET)
    return e.select("book_id", "page", "entry_ord", "candidates", "gate", F.size("reasons").cast("long").alias("n_reasons"))


def _links(pairs: DataFrame, native: bool = False) -> DataFrame:
    p = pairs.where("reason is null").select(*_SHEET, "entry_ord", "region_ord", "cost")
    greedy = matching.greedy_by_rounds if native else matching.greedy_by_sheet
    return greedy(p, _SHEET, "entry_ord", "region_ord", ["cost", "entry_ord", "region_ord"]).select(*_SHEET, "entry_ord", "region_ord")


_GREEDY = f"""WITH RECURSIVE {_PLACED},
cand AS (SELECT book_id, page, entry_ord, region_ord, row_number() OVER (PARTITION BY book_id, page ORDER BY cost, entry_ord, region_ord) AS k FROM pr WHERE reason IS NULL),
step AS (SELECT book_id, page, 0::BIGINT AS k, []::VARCHAR[] AS es, []::VARCHAR[] AS rs, false AS won, ''::VARCHAR AS e, ''::VARCHAR AS r FROM (SELECT DISTINCT book_id, page FROM cand)
  UNION ALL SELECT s.book_id, s.page, c.k, CASE WHEN ok THEN list_append(s.es, c.entry_ord) ELSE s.es END, CASE WHEN ok THEN list_append(s.rs, c.region_ord) ELSE s.rs END, ok, c.entry_ord, c.region_ord
  FROM step s JOIN cand c ON c.book_id = s.book_id AND c.page = s.page AND c.k = s.k + 1, LATERAL (SELECT NOT list_contains(s.es, c.entry_ord) AND NOT list_contains(s.rs, c.region_ord) AS ok)),
links AS (SELECT book_id, page, e AS entry_ord, r AS region_ord FROM step WHERE won)"""


@query(f"{_GREEDY} SELECT book_id, page, entry_ord, region_ord FROM links")
def region_entry_links(spark, d) -> DataFrame:
    """Greedy one-to-one links of entries and regions, cheapest first, sheet by sheet."""
    return _links(matching.gated_pairs(*_placed(spark, d), _SHEET))


@query(f"{_GREEDY} SELECT book_id, page, entry_ord, region_ord FROM links")
def region_entry_links_native(spark, d) -> DataFrame:
    """The same links by rounds of mutual first choices, without Python."""
    return _links(matching.gated_pairs(*_placed(spark, d), _SHEET), native=True)


@query(f"""{_GREEDY}, forced AS (SELECT book_id, page, entry_ord, max(region_ord) AS region_ord FROM pr GROUP BY 1, 2, 3 HAVING count(*) = 1),
kept AS (SELECT * FROM links l WHERE NOT EXISTS (SELECT 1 FROM forced f WHERE f.book_id = l.book_id AND f.page = l.page AND (f.entry_ord = l.entry_ord OR f.region_ord = l.region_ord)))
SELECT * FROM kept UNION ALL SELECT * FROM forced""")
def claimed_override(spark, d) -> DataFrame:
    """Links with every entry that has one region only forced onto it."""
    p = reliable(matching.gated_pairs(*_placed(spark, d), _SHEET).select(*_SHEET, "entry_ord", "region_ord", "cost", "reason"))
    forced = p.groupBy(*_SHEET, "entry_ord").agg(F.max("region_ord").alias("region_ord"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return matching.override_claims(_links(p), forced, _SHEET, "entry_ord", "region_ord")


@query(f"{_GREEDY} SELECT et.book_id, et.page, et.entry_ord, row_number() OVER (PARTITION BY et.book_id ORDER BY et.entry_ord, et.page) AS number FROM (SELECT DISTINCT book_id, page, entry_ord FROM et) et ANTI JOIN links USING (book_id, page, entry_ord)")
def unclaimed_entries(spark, d) -> DataFrame:
    """Entries that no region of their sheet got, numbered through the book in manifest order (by id here)."""
    e, r = _placed(spark, d)
    left = e.select(*_SHEET, "entry_ord").distinct().join(_links(matching.gated_pairs(e, r, _SHEET)), [*_SHEET, "entry_ord"], "left_anti")
    return numbered(left, ["book_id"], ["entry_ord", "page"]).select(*_SHEET, "entry_ord", "number")


@query(f"{_GREEDY} SELECT et.book_id, count(*) AS n_claimed FROM (SELECT DISTINCT book_id, page, entry_ord FROM et) et SEMI JOIN links USING (book_id, page, entry_ord) GROUP BY 1")
def claimed_entries(spark, d) -> DataFrame:
    """Entries that a region of their sheet got, per book."""
    e, r = _placed(spark, d)
    got = e.select(*_SHEET, "entry_ord").distinct().join(_links(matching.gated_pairs(e, r, _SHEET)), [*_SHEET, "entry_ord"], "left_semi")
    return got.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_claimed"))


@query(f"""{_GREEDY} SELECT rg.book_id, rg.region_ord, l.entry_ord, 'spot' AS kind FROM rg LEFT JOIN links l USING (book_id, page, region_ord)
UNION ALL SELECT et.book_id, NULL, et.entry_ord, 'pin' FROM et ANTI JOIN links USING (book_id, page, entry_ord) WHERE y IS NOT NULL AND NOT (posx = 0 AND posy = 0)""")
def overlay_full_outer(spark, d) -> DataFrame:
    """Every region with its entry, and a pin for every placed entry without a region."""
    e, r = _placed(spark, d)
    links = reliable(_links(matching.gated_pairs(e, r, _SHEET)))
    spots = r.join(links, [*_SHEET, "region_ord"], "left").select("book_id", "region_ord", "entry_ord", F.lit("spot").alias("kind"))
    pins = e.where(F.col("y").isNotNull() & views.has_position()).join(links, [*_SHEET, "entry_ord"], "left_anti").select("book_id", F.lit(None).cast("string").alias("region_ord"), "entry_ord", F.lit("pin").alias("kind"))
    return spots.unionByName(pins)


@query(f"""WITH {views.SQL}, p AS (SELECT span_id, book_id, page, (bbox.x0 + bbox.x1) / 2 AS x, (bbox.y0 + bbox.y1) / 2 AS y FROM spans WHERE bbox IS NOT NULL)
SELECT span_id, arg_min(activity_key, struct_pack(a := round((rect.x1 - rect.x0) * (rect.y1 - rect.y0), 6), o := activity_key)) AS region FROM p JOIN act ON act.book_id = p.book_id AND act.page = p.page WHERE x BETWEEN rect.x0 AND rect.x1 AND y BETWEEN rect.y0 AND rect.y1 GROUP BY 1""")
def hit_test_smallest(spark, d) -> DataFrame:
    """The smallest region under the middle of each line, the first of equals."""
    b, r = F.col("bbox"), F.col("rect")
    p = table(spark, d, "spans").where("bbox is not null").select("span_id", "book_id", "page", ((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))
    hit = p.join(views.activities(spark, d).select("book_id", "page", "activity_key", "rect"), ["book_id", "page"]).where(geo.contains_point(r, F.col("x"), F.col("y")))
    size = F.round((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]), 6)
    return hit.groupBy("span_id").agg(F.min_by("activity_key", F.struct(size, F.col("activity_key"))).alias("region"))


@query(f"""WITH {_PLACED}, w AS (SELECT entry_ord, max(CASE WHEN reach = 0 AND y BETWEEN t AND b THEN 3 WHEN y BETWEEN t - 5 AND b + 5 THEN 2 ELSE 1 END) AS k, min(abs(y - t)) AS gap FROM pr0 WHERE y IS NOT NULL GROUP BY 1)
SELECT CASE k WHEN 3 THEN 'icon in a box' WHEN 2 THEN 'icon beside a box' WHEN 1 THEN 'box elsewhere' ELSE 'no box on page' END AS place, count(*) AS n, round(min(gap), 4) AS least_gap
FROM (SELECT et.entry_ord, coalesce(k, 0) AS k, gap FROM et LEFT JOIN w USING (entry_ord) WHERE et.y IS NOT NULL) GROUP BY 1""")
def nearest_gap_where(spark, d) -> DataFrame:
    """Where each placed entry stands to the regions of its page."""
    e, r = _placed(spark, d)
    p = e.where("y is not null").join(r, _SHEET, "left")
    none = F.col("region_ord").isNull()
    inside = (matching.reach(F.col("x"), F.col("left"), F.col("right")) == 0) & F.col("y").between(F.col("top"), F.col("bottom"))
    k = F.when(none, 0).when(inside, 3).when(F.col("y").between(F.col("top") - 5, F.col("bottom") + 5), 2).otherwise(1)
    w = p.groupBy("entry_ord").agg(F.max(k).alias("k"), F.min(F.abs(F.col("y") - F.col("top"))).alias("gap"))
    place = F.when(F.col("k") == 3, "icon in a box").when(F.col("k") == 2, "icon beside a box").when(F.col("k") == 1, "box elsewhere").otherwise("no box on page")
    return w.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("gap"), 4).alias("least_gap"))


_GROWN = "SELECT DISTINCT activity_key, item_key AS o, rect.x0 - 8 AS x0, rect.y0 - 8 AS y0, rect.x1 + 8 AS x1, rect.y1 + 8 AS y1 FROM item WHERE rect IS NOT NULL"
_BOTH = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query(f"""WITH p AS ({_GROWN}) SELECT a.o AS a, b.o AS b, round({_BOTH}, 4) AS shared FROM p a JOIN p b ON a.activity_key = b.activity_key AND a.o < b.o WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND {_BOTH} > 1""")
def overlap_self_join(spark, d) -> DataFrame:
    """Pairs of a region's items, padded by eight points, that share more than one square point."""
    r = F.col("rect")
    a = table(spark, d, "item").where("rect is not null").select("activity_key", F.col("item_key").alias("a"), geo.rect(r["x0"] - 8, r["y0"] - 8, r["x1"] + 8, r["y1"] + 8).alias("ra")).distinct()
    b = a.select("activity_key", F.col("a").alias("b"), F.col("ra").alias("rb"))
    shared = geo.overlap(F.col("ra"), F.col("rb"))
    return a.join(b, "activity_key").where((F.col("a") < F.col("b")) & geo.intersects(F.col("ra"), F.col("rb")) & (shared > 1)).select("a", "b", F.round(shared, 4).alias("shared"))


@query(f"""WITH {views.SQL}, blk AS (SELECT book_id, page, span_id, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1, (bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0) AS area FROM spans WHERE bbox IS NOT NULL),
p AS (SELECT blk.*, act.rect AS r, greatest(least(x1, act.rect.x1) - greatest(x0, act.rect.x0), 0) * greatest(least(y1, act.rect.y1) - greatest(y0, act.rect.y0), 0) / nullif(area, 0) AS share FROM blk JOIN act USING (book_id, page))
SELECT CASE WHEN (x0 < r.x0 OR x1 > r.x1) AND (y0 < r.y0 OR y1 > r.y1) THEN 'corner' WHEN x0 < r.x0 OR x1 > r.x1 THEN 'side' WHEN y0 < r.y0 OR y1 > r.y1 THEN 'end' ELSE 'inside' END AS edge, count(*) AS n
FROM p WHERE share > 0.05 AND share < 0.95 GROUP BY 1""")
def cut_census(spark, d) -> DataFrame:
    """How regions cut the lines of their sheet, by the edge left outside."""
    blocks = table(spark, d, "spans").where("bbox is not null").select("book_id", "page", "span_id", "bbox")
    p = blocks.join(views.activities(spark, d).select("book_id", "page", "rect"), ["book_id", "page"]).where(geo.cuts(F.col("rect"), F.col("bbox")))
    return p.groupBy(geo.straddles(F.col("rect"), F.col("bbox")).alias("edge")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {views.SQL}, sp AS (SELECT span_id, book_id, page, (bbox.x0 + bbox.x1) / 2 AS cx, (bbox.y0 + bbox.y1) / 2 AS cy FROM spans WHERE length(trim(text)) > 0),
h AS (SELECT span_id, bool_or(act.activity_key IS NOT NULL) AS held, bool_or(coalesce(act.kind = 'activity', false)) AS by_activity FROM sp LEFT JOIN act ON act.book_id = sp.book_id AND act.page = sp.page
  AND cx BETWEEN rect.x0 AND rect.x1 AND cy BETWEEN rect.y0 AND rect.y1 GROUP BY 1)
SELECT sp.book_id, count(*) AS n_lines, count(*) FILTER (WHERE held) AS n_held, count(*) FILTER (WHERE by_activity) AS n_by_activity FROM sp JOIN h USING (span_id) GROUP BY 1""")
def line_coverage(spark, d) -> DataFrame:
    """Lines whose centre lies in a region, per book."""
    s = table(spark, d, "spans").where("length(trim(text)) > 0").select("span_id", "book_id", "page", ((F.col("bbox.x0") + F.col("bbox.x1")) / 2).alias("cx"), ((F.col("bbox.y0") + F.col("bbox.y1")) / 2).alias("cy"))
    a = views.activities(spark, d).select("book_id", "page", "rect", "kind")
    held = s.join(a, ["book_id", "page"]).where(geo.contains_point(F.col("rect"), F.col("cx"), F.col("cy"))).groupBy("span_id").agg(F.bool_or(F.col("kind") == "activity").alias("by_activity"))
    return s.join(held, "span_id", "left").groupBy("book_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count("by_activity").alias("n_held"), F.count_if("by_activity").alias("n_by_activity"))


@query(f"""WITH {views.SQL}, i AS (SELECT DISTINCT item_key, activity_key, rect FROM item WHERE rect IS NOT NULL), own AS (SELECT i.item_key, i.rect, a.book_id, a.page, min(a.rect.x0 <= i.rect.x0 + 8 AND a.rect.y0 <= i.rect.y0 + 8 AND a.rect.x1 >= i.rect.x1 - 8 AND a.rect.y1 >= i.rect.y1 - 8) AS inside FROM i JOIN act a USING (activity_key) GROUP BY ALL),
hit AS (SELECT own.item_key, own.rect, inside, arg_min(a.activity_key, struct_pack(s := round((a.rect.x1 - a.rect.x0) * (a.rect.y1 - a.rect.y0), 6), k := a.activity_key)) FILTER (WHERE (own.rect.x0 + own.rect.x1) / 2 BETWEEN a.rect.x0 AND a.rect.x1 AND (own.rect.y0 + own.rect.y1) / 2 BETWEEN a.rect.y0 AND a.rect.y1) AS parent
  FROM own JOIN act a USING (book_id, page) GROUP BY ALL) SELECT item_key, inside, parent FROM hit""")
def items_in_parent(spark, d) -> DataFrame:
    """Sub-items with whether they lie in their own region (eight points allowed), and the smallest region of the sheet that holds their middle."""
    act = views.activities(spark, d)
    i = table(spark, d, "item").where("rect is not null").select("item_key", "activity_key", F.col("rect").alias("ri")).distinct()
    own = i.join(act.select("activity_key", "book_id", "page", "rect"), "activity_key").groupBy("item_key", "ri", "book_id", "page").agg(F.bool_and(geo.encloses(F.col("rect"), F.col("ri"), 8.0)).alias("inside"))
    r, m = F.col("rect"), F.col("ri")
    held = geo.contains_point(r, (m["x0"] + m["x1"]) / 2, (m["y0"] + m["y1"]) / 2)
    order = F.when(held, F.struct(F.round((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]), 6), F.col("activity_key")))
    return own.join(act.select("book_id", "page", "activity_key", "rect"), ["book_id", "page"]).groupBy("item_key", "ri", "inside").agg(F.min_by("activity_key", order).alias("parent")).select("item_key", "inside", "parent")


@query(f"""WITH {views.SQL}, p AS (SELECT DISTINCT book_id, page FROM act WHERE kind = 'activity'), m AS (SELECT DISTINCT sh.book_id, sh.page FROM sh JOIN en ON en.book_id = sh.book_id AND en.sayfano = sh.printed_page)
SELECT sh.book_id, count(*) FILTER (WHERE m.page IS NOT NULL) AS manifest, count(*) FILTER (WHERE m.page IS NULL AND p.page IS NOT NULL) AS baked, count(*) FILTER (WHERE m.page IS NULL AND p.page IS NULL) AS bare
FROM sh LEFT JOIN p USING (book_id, page) LEFT JOIN m USING (book_id, page) WHERE sh.width <= 700 GROUP BY 1""")
def page_strata(spark, d) -> DataFrame:
    """Sheets of a book that publisher entries name, that hold regions, or neither; spreads left out."""
    s = views.sheets(spark, d)
    has = views.activities(spark, d).where("kind = 'activity'").select("book_id", "page").distinct().withColumn("p", F.lit(True))
    named = s.join(views.entries(spark, d).select("book_id", F.col("sayfano").alias("printed_page")).distinct(), ["book_id", "printed_page"]).select("book_id", "page").distinct().withColumn("m", F.lit(True))
    j = s.where("width <= 700").join(has, ["book_id", "page"], "left").join(named, ["book_id", "page"], "left")
    return j.groupBy("book_id").agg(F.count_if(F.col("m").isNotNull()).alias("manifest"), F.count_if(F.col("m").isNull() & F.col("p").isNotNull()).alias("baked"), F.count_if(F.col("m").isNull() & F.col("p").isNull()).alias("bare"))


def _boxes(spark, d) -> DataFrame:
    """Boxes from the first four numbers of the vectors, 40 points wide and high, in fives of ids."""
    e = table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(3)])
    x0, y0 = F.round(100 + 200 * F.col("v0"), 3), F.round(100 + 200 * F.col("v1"), 3)
    return e.select(F.col("label").cast("int").alias("label"), (F.col("vec_id") % 10).alias("page"), F.col("vec_id").alias("ord"), F.round("v2", 6).alias("score"), x0.alias("x0"), y0.alias("y0"), F.round(x0 + 40, 3).alias("x1"), F.round(y0 + 40, 3).alias("y1"))


_BOX = """bx AS (SELECT label, vec_id % 10 AS page, vec_id AS ord, round(embedding[3]::DOUBLE, 6) AS score, round(100 + 200 * embedding[1]::DOUBLE, 3) AS x0, round(100 + 200 * embedding[2]::DOUBLE, 3) AS y0 FROM embeddings)"""
_SHARED = "greatest(40 - abs(a.x0 - b.x0), 0) * greatest(40 - abs(a.y0 - b.y0), 0)"
_NMS = """WITH RECURSIVE {box}, r AS (SELECT *, row_number() OVER (PARTITION BY label, page ORDER BY score DESC, ord) AS k FROM bx),
bad AS (SELECT a.label, a.page, a.k AS ka, b.k AS kb FROM r a JOIN r b ON a.label = b.label AND a.page = b.page AND a.k < b.k WHERE {rule}),
step AS (SELECT label, page, 0::BIGINT AS k, []::BIGINT[] AS kept FROM (SELECT DISTINCT label, page FROM r)
  UNION ALL SELECT s.label, s.page, r.k, CASE WHEN EXISTS (SELECT 1 FROM bad WHERE bad.label = s.label AND bad.page = s.page AND bad.kb = r.k AND list_contains(s.kept, bad.ka)) THEN s.kept ELSE list_append(s.kept, r.k) END
  FROM step s JOIN r ON r.label = s.label AND r.page = s.page AND r.k = s.k + 1),
fin AS (SELECT label, page, arg_max(kept, k) AS kept FROM step GROUP BY 1, 2)
SELECT r.label, r.page, r.ord FROM r JOIN fin ON fin.label = r.label AND fin.page = r.page AND list_contains(fin.kept, r.k)"""


@query(_NMS.format(box=_BOX, rule=f"{_SHARED} >= 0.5 * (3200 - {_SHARED})"))
def nms_suppress(spark, d) -> DataFrame:
    """Boxes that survive non-maximum suppression at IoU .5."""
    return matching.suppress(_boxes(spark, d), ["label", "page"], "score", "ord").select("label", "page", "ord")


@query(_NMS.format(box=_BOX, rule=f"{_SHARED} >= 0.6 * 1600"))
def nested_drop(spark, d) -> DataFrame:
    """Boxes of which no better one holds six tenths."""
    return matching.suppress(_boxes(spark, d), ["label", "page"], "score", "ord", 0.6, nested=True).select("label", "page", "ord")


# Odd boxes against even ones of two pages taken together; one recursion a page takes the predictions by score.
_MATCH = """WITH RECURSIVE {box}, pd AS (SELECT label, page // 2 AS page, ord, score, x0, y0, row_number() OVER (PARTITION BY label, page // 2 ORDER BY score DESC, ord) AS k FROM bx WHERE ord % 2 = 1),
tr AS (SELECT label, page // 2 AS page, ord, x0, y0 FROM bx WHERE ord % 2 = 0),
iou AS (SELECT * FROM (SELECT a.label, a.page, a.k, b.ord AS t, {shared} / (3200 - {shared}) AS v FROM pd a JOIN tr b ON a.label = b.label AND a.page = b.page) WHERE v > 0),
step AS (SELECT label, page, lim, 0::BIGINT AS k, []::BIGINT[] AS used, false AS hit FROM (SELECT DISTINCT label, page FROM pd), (SELECT unnest([{steps}]) AS lim)
  UNION ALL SELECT s.label, s.page, s.lim, s.k + 1, CASE WHEN t IS NULL THEN s.used ELSE list_append(s.used, t) END, t IS NOT NULL FROM (SELECT s.*,
      (SELECT arg_min(i.t, struct_pack(a := -i.v, b := i.t)) FROM iou i WHERE i.label = s.label AND i.page = s.page AND i.k = s.k + 1 AND i.v >= s.lim AND NOT list_contains(s.used, i.t)) AS t
    FROM step s WHERE EXISTS (SELECT 1 FROM pd WHERE pd.label = s.label AND pd.page = s.page AND pd.k = s.k + 1)) s),
hits AS (SELECT step.label, step.page, lim, pd.ord, pd.score, hit FROM step JOIN pd ON pd.label = step.label AND pd.page = step.page AND pd.k = step.k)"""


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    b = _boxes(spark, d).withColumn("page", F.floor(F.col("page") / 2)).select("label", "page", "ord", "score", "x0", "y0", "x1", "y1")
    return b.where("ord % 2 = 1"), b.where("ord % 2 = 0").drop("score")


@query(f"""{_MATCH.format(box=_BOX, shared=_SHARED, steps='0.3')}, h AS (SELECT label, count(*) FILTER (WHERE hit) AS hits, count(*) AS n_pred FROM hits GROUP BY 1), n AS (SELECT label, count(*) AS n_truth FROM tr GROUP BY 1)
SELECT label, hits, n_pred, n_truth, round(hits / n_pred, 6) AS precision, round(hits / n_truth, 6) AS recall FROM h JOIN n USING (label)""")
def iou_match_precision_recall(spark, d) -> DataFrame:
    """Greedy IoU matching of odd boxes against even ones, precision and recall per label."""
    pred, truth = _halves(spark, d)
    hits = matching.match_detections(pred, truth, ["label", "page"], (0.3,)).groupBy("label").agg(F.count_if(F.col("hits")[0]).alias("hits"), F.count(F.lit(1)).alias("n_pred"))
    n = truth.groupBy("label").agg(F.count(F.lit(1)).alias("n_truth"))
    return hits.join(n, "label").select("label", "hits", "n_pred", "n_truth", F.round(F.col("hits") / F.col("n_pred"), 6).alias("precision"), F.round(F.col("hits") / F.col("n_truth"), 6).alias("recall"))


@query(f"""{_MATCH.format(box=_BOX, shared=_SHARED, steps=', '.join(f'{x:.2f}' for x in detection.STEPS))},
pg AS (SELECT DISTINCT label, page // 2 AS page FROM bx), nt AS (SELECT label, page, count(*) AS n FROM tr GROUP BY 1, 2), np AS (SELECT label, page, count(*) AS n, count(*) FILTER (WHERE hit) AS h FROM hits WHERE lim = 0.5 AND score >= 0 GROUP BY 1, 2),
pp AS (SELECT s.scope, pg.label, pg.page, coalesce(nt.n, 0) AS n, coalesce(np.n, 0) AS m, coalesce(np.h, 0) AS h FROM pg LEFT JOIN nt USING (label, page) LEFT JOIN np USING (label, page), LATERAL (SELECT unnest([pg.label::VARCHAR, 'total']) AS scope) s),
c AS (SELECT scope, count(*) AS pages, sum(n)::BIGINT AS teacher_boxes, sum(m)::BIGINT AS predicted_boxes, sum(h) AS nh, count(*) FILTER (WHERE n = 0) AS empty_pages, count(*) FILTER (WHERE n = 0 AND m > 0) AS empty_pages_with_a_box FROM pp GROUP BY 1),
r AS (SELECT s.scope, lim, hit, sum(hit::INT) OVER w AS tp, row_number() OVER w AS k FROM hits, LATERAL (SELECT unnest([hits.label::VARCHAR, 'total']) AS scope) s WINDOW w AS (PARTITION BY s.scope, lim ORDER BY score DESC, label, page, ord ROWS UNBOUNDED PRECEDING)),
e AS (SELECT r.scope, lim, (tp * 100 // teacher_boxes)::INT AS last, max(tp / k) AS v FROM r JOIN c USING (scope) WHERE teacher_boxes > 0 GROUP BY 1, 2, 3),
ap AS (SELECT c.scope, a.lim, avg(coalesce((SELECT max(v) FROM e WHERE e.scope = c.scope AND e.lim = a.lim AND e.last >= t), 0)) AS ap FROM c, (SELECT DISTINCT lim FROM step) a, range(0, 101) g(t) WHERE teacher_boxes > 0 GROUP BY 1, 2)
SELECT c.scope, pages, teacher_boxes, predicted_boxes, round(max(ap) FILTER (WHERE lim = 0.5), 4) AS map50, round(avg(ap), 4) AS map50_95, round(any_value(nh) / nullif(any_value(predicted_boxes), 0), 4) AS precision,
  round(any_value(nh) / nullif(any_value(teacher_boxes), 0), 4) AS recall, empty_pages, empty_pages_with_a_box FROM c LEFT JOIN ap USING (scope) GROUP BY ALL""")
def detection_summary(spark, d) -> DataFrame:
    """Detection scores per label and in total; average precision of the total is taken anew over all pages."""
    pred, truth = _halves(spark, d)
    pages = _boxes(spark, d).select("label", F.floor(F.col("page") / 2).alias("page"))
    return detection.scores(pages, pred, truth, conf=0.0, book="label", page="page")


@query(f"""WITH {_BOX}, a AS (SELECT label, page // 2 AS page, ord, x0, y0 FROM bx WHERE ord % 2 = 1), b AS (SELECT label, page // 2 AS page, ord, x0, y0 FROM bx WHERE ord % 2 = 0)
SELECT label, page, (SELECT count(*) FROM a WHERE a.label = p.label AND a.page = p.page) AS n_a, (SELECT count(*) FROM b WHERE b.label = p.label AND b.page = p.page) AS n_b FROM (SELECT label, page FROM a UNION SELECT label, page FROM b) p""")
def agreement_boxes(spark, d) -> DataFrame:
    """Boxes of two labellers per page."""
    a, b = _halves(spark, d)
    return matching.mutual_matches(a.drop("score"), b, ["label", "page"], 0.3).select("label", "page", "n_a", "n_b")


@query(f"""WITH RECURSIVE {_BOX}, a AS (SELECT label, page // 2 AS page, ord, x0, y0, row_number() OVER (PARTITION BY label, page // 2 ORDER BY ord) AS i FROM bx WHERE ord % 2 = 1), b AS (SELECT label, page // 2 AS page, ord, x0, y0, row_number() OVER (PARTITION BY label, page // 2 ORDER BY ord) AS j FROM bx WHERE ord % 2 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY label, page ORDER BY v DESC, i DESC, j DESC) AS k FROM (SELECT a.label, a.page, i, j, {_SHARED} / (3200 - {_SHARED}) AS v FROM a JOIN b ON a.label = b.label AND a.page = b.page) WHERE v >= 0.3),
pg AS (SELECT label, page FROM a UNION SELECT label, page FROM b),
step AS (SELECT label, page, 0::BIGINT AS k, []::BIGINT[] AS l, []::BIGINT[] AS r FROM pg UNION ALL SELECT s.label, s.page, c.k, CASE WHEN ok THEN list_append(l, i) ELSE l END, CASE WHEN ok THEN list_append(r, j) ELSE r END
  FROM step s JOIN c ON c.label = s.label AND c.page = s.page AND c.k = s.k + 1, LATERAL (SELECT NOT list_contains(s.l, c.i) AND NOT list_contains(s.r, c.j) AS ok)),
m AS (SELECT label, page, max(len(l)) AS matches FROM step GROUP BY 1, 2), n AS (SELECT pg.label, pg.page, (SELECT count(*) FROM a WHERE a.label = pg.label AND a.page = pg.page) AS n_a, (SELECT count(*) FROM b WHERE b.label = pg.label AND b.page = pg.page) AS n_b FROM pg)
SELECT label, page, n_a, n_b, matches, 2 * matches / (n_a + n_b) AS agreement FROM n JOIN m USING (label, page)""")
def agreement_mutual(spark, d) -> DataFrame:
    """Symmetric matching of two labellers' boxes, best pair first."""
    a, b = _halves(spark, d)
    return matching.mutual_matches(a.drop("score"), b, ["label", "page"], 0.3)


@query(f"WITH {_BOX}, p AS (SELECT a.label, a.page, a.ord, max({_SHARED} / (3200 - {_SHARED})) AS best FROM bx a JOIN bx b ON a.label = b.label AND a.page = b.page AND a.ord <> b.ord GROUP BY 1, 2, 3) SELECT label, page, ord, round(best, 5) AS best FROM p")
def best_iou(spark, d) -> DataFrame:
    """Greatest IoU of each box with another of its page."""
    b = _boxes(spark, d).select("label", "page", "ord", geo.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("r"))
    o = b.select("label", "page", F.col("ord").alias("other"), F.col("r").alias("q"))
    return b.join(o, ["label", "page"]).where("ord <> other").groupBy("label", "page", "ord").agg(F.round(F.max(geo.iou(F.col("r"), F.col("q"))), 5).alias("best"))


@query(f"""WITH RECURSIVE {views.SQL}, n AS (SELECT DISTINCT activity_key AS v, book_id, page, rect FROM act),
e AS (SELECT a.v AS u, b.v AS v FROM n a JOIN n b ON a.book_id = b.book_id AND a.page = b.page AND a.v <> b.v
  AND a.rect.x0 <= b.rect.x1 + 30 AND b.rect.x0 <= a.rect.x1 + 30 AND a.rect.y0 <= b.rect.y1 + 30 AND b.rect.y0 <= a.rect.y1 + 30),
w AS (SELECT v, v AS l FROM n UNION SELECT e.v, w.l FROM w JOIN e ON e.u = w.v)
SELECT v AS activity_key, min(l) AS island FROM w GROUP BY 1""")
def connected_components(spark, d) -> DataFrame:
    """Regions of a sheet welded with neighbours at most 30 points away: the smallest key of each island."""
    a = views.activities(spark, d).select("book_id", "page", F.col("activity_key").alias("u"), F.col("rect").alias("ru")).distinct()
    b = a.select("book_id", "page", F.col("u").alias("v"), F.col("ru").alias("rv"))
    ru, rv = F.col("ru"), F.col("rv")
    near = (ru["x0"] <= rv["x1"] + 30) & (rv["x0"] <= ru["x1"] + 30) & (ru["y0"] <= rv["y1"] + 30) & (rv["y0"] <= ru["y1"] + 30)
    edges = a.join(b, ["book_id", "page"]).where((F.col("u") < F.col("v")) & near).select("u", "v")
    return graph.min_label(a.select("u"), edges).select(F.col("vertex").alias("activity_key"), F.col("label").alias("island"))


@query(f"""WITH {views.SQL}, a AS (SELECT book_id, page, list_sort(list(DISTINCT lower(label))) AS xs FROM act WHERE label IS NOT NULL GROUP BY 1, 2),
b AS (SELECT book_id, page, list_sort(list(DISTINCT lower(i.label))) AS ys FROM (SELECT DISTINCT activity_key, label FROM item WHERE label IS NOT NULL) i JOIN act USING (activity_key) GROUP BY 1, 2)
SELECT book_id, page, round(len(list_intersect(xs, ys)) / len(list_distinct(list_concat(xs, ys))), 6) AS jaccard FROM a JOIN b USING (book_id, page)""")
def jaccard_content(spark, d) -> DataFrame:
    """Jaccard share of a sheet's region labels and item labels."""
    from pagewright.operators.metrics import jaccard

    act = views.activities(spark, d)
    a = act.where("label is not null").groupBy("book_id", "page").agg(F.collect_set(F.lower("label")).alias("xs"))
    items = table(spark, d, "item").where("label is not null").select("activity_key", F.col("label").alias("il")).distinct()
    b = items.join(act.select("activity_key", "book_id", "page"), "activity_key").groupBy("book_id", "page").agg(F.collect_set(F.lower("il")).alias("ys"))
    return a.join(b, ["book_id", "page"]).select("book_id", "page", F.round(jaccard(F.col("xs"), F.col("ys")), 6).alias("jaccard"))


@query("""WITH s AS (SELECT DISTINCT * EXCLUDE (row_id) FROM book_score), f AS (SELECT book_id, arg_min(regions, run_no) AS r0, arg_min(pages_with_regions / nullif(pages, 0), run_no) AS c0, arg_max(regions, run_no) AS r1, arg_max(pages_with_regions / nullif(pages, 0), run_no) AS c1, count(DISTINCT run_no) AS runs FROM s GROUP BY 1),
g AS (SELECT book_id, unnest([x FOR x IN [CASE WHEN runs < 2 THEN 'missing' END, CASE WHEN c0 - c1 > 0.05 THEN 'lost coverage' END, CASE WHEN (r0 - r1) / nullif(r0, 0) > 0.2 THEN 'lost regions' END, CASE WHEN r1 - r0 > 10 AND (r1 - r0) / nullif(r0, 0) > 0.2 THEN 'gained regions' END] IF x IS NOT NULL]) AS gate FROM f)
SELECT book_id, gate FROM g""")
def gate_before_after(spark, d) -> DataFrame:
    """Gates that a book's last run fails against its first."""
    s = table(spark, d, "book_score").drop("row_id").distinct().withColumn("c", F.col("pages_with_regions") / F.nullif(F.col("pages"), F.lit(0)))
    f = s.groupBy("book_id").agg(F.min_by("regions", "run_no").alias("r0"), F.min_by("c", "run_no").alias("c0"), F.max_by("regions", "run_no").alias("r1"), F.max_by("c", "run_no").alias("c1"), F.countDistinct("run_no").alias("runs"))
    share = F.nullif(F.col("r0"), F.lit(0))
    gates = F.array_compact(F.array(F.when(F.col("runs") < 2, "missing"), F.when(F.col("c0") - F.col("c1") > 0.05, "lost coverage"), F.when((F.col("r0") - F.col("r1")) / share > 0.2, "lost regions"),
                                    F.when((F.col("r1") - F.col("r0") > 10) & ((F.col("r1") - F.col("r0")) / share > 0.2), "gained regions")))
    return f.select("book_id", F.explode(gates).alias("gate"))


@query("""WITH n AS (SELECT id, max(kayit_zamani) AS t, bool_or(silinme_zamani IS NULL) AS live FROM kitap GROUP BY 1), o AS (SELECT DISTINCT klasoradi, id FROM kitap),
s AS (SELECT DISTINCT book_id FROM sheets) SELECT CASE WHEN s.book_id IS NULL THEN 'absent' WHEN live THEN 'installed' ELSE 'withdrawn' END AS state, count(*) AS n FROM o JOIN n USING (id) LEFT JOIN s ON s.book_id = o.klasoradi GROUP BY 1""")
def catalogue_states(spark, d) -> DataFrame:
    """Catalogue books by whether sheets of them are loaded and a delivery is live."""
    k = table(spark, d, "kitap")
    n = k.groupBy("id").agg(F.bool_or(F.col("silinme_zamani").isNull()).alias("live"))
    s = table(spark, d, "sheets").select(F.col("book_id").alias("klasoradi")).distinct().withColumn("here", F.lit(True))
    j = k.select("id", "klasoradi").distinct().join(n, "id").join(s, "klasoradi", "left")
    return j.groupBy(F.when(F.col("here").isNull(), "absent").when(F.col("live"), "installed").otherwise("withdrawn").alias("state")).agg(F.count(F.lit(1)).alias("n"))


