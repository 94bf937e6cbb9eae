"""Tallies, votes, histograms, quantiles and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import geometry as geo
from pagewright.functions import text as tx
from pagewright.operators import matching, metrics, tally, views
from pagewright.plans import joins
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


@query("""SELECT template, band, count(*) AS n_runs, sum(regions)::BIGINT AS regions, sum(panels_cut + solutions_cut)::BIGINT AS cuts, sum("overlaps")::BIGINT AS "overlaps",
  grouping(template)::BIGINT AS all_templates, grouping(band)::BIGINT AS all_bands FROM (SELECT DISTINCT * EXCLUDE (row_id) FROM book_score) GROUP BY ROLLUP (template, band)""")
def tally_rollup(spark, d) -> DataFrame:
    """Counters per template and band with subtotals and the grand total."""
    return _scores(spark, d).rollup("template", "band").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("regions").alias("regions"), F.sum(F.col("panels_cut") + F.col("solutions_cut")).alias("cuts"), F.sum("overlaps").alias("overlaps"),
        F.grouping("template").cast("long").alias("all_templates"), F.grouping("band").cast("long").alias("all_bands"))


def _scores(spark, d) -> DataFrame:
    t = table(spark, d, "book_score")
    return t.drop("row_id").distinct()


_BS = "s AS (SELECT DISTINCT * EXCLUDE (row_id) FROM book_score)"


@query(f"""WITH {_BS} SELECT book_id, run_no, round((panels_cut + solutions_cut) / nullif(regions, 0), 6) AS cut_rate, round(matched / nullif(oges, 0), 6) AS match_rate,
  round(pages_with_regions / nullif(pages, 0), 6) AS coverage,
  round(100 * coalesce((panels_cut + solutions_cut) / nullif(regions, 0), 0) + 200 * coalesce("overlaps" / nullif(regions, 0), 0) + 40 * coalesce(tall / nullif(regions, 0), 0)
    + 40 * coalesce(slivers / nullif(regions, 0), 0) + CASE WHEN oges > 0 THEN 20 * (oges - matched) / oges ELSE 0 END - coalesce(pages_with_regions / nullif(pages, 0), 0), 6) AS loss FROM s""")
def book_rates_loss(spark, d) -> DataFrame:
    """Rates of each run (null where nothing was counted) and its weighted loss (then 0); a book without entries pays no miss."""
    return tally.rates(_scores(spark, d)).select("book_id", "run_no", *[F.round(c, 6).alias(c) for c in ("cut_rate", "match_rate", "coverage", "loss")])


@query(f"""WITH {_BS} SELECT coalesce(template, '-') AS engine, sum(regions)::BIGINT AS regions, sum(matched)::BIGINT AS matched, round(sum(matched) / nullif(sum(oges), 0), 6) AS match_rate,
  round(avg(coalesce(pages_with_regions / nullif(pages, 0), 0)), 6) AS coverage FROM s GROUP BY 1""")
def engine_totals(spark, d) -> DataFrame:
    """Sums per engine, rates from the sums, coverage as plain mean with unknown as 0."""
    return _scores(spark, d).groupBy(F.coalesce("template", F.lit("-")).alias("engine")).agg(
        F.sum("regions").alias("regions"), F.sum("matched").alias("matched"), F.round(F.try_divide(F.sum("matched"), F.nullif(F.sum("oges"), F.lit(0))), 6).alias("match_rate"),
        F.round(F.avg(F.coalesce(F.try_divide("pages_with_regions", "pages"), F.lit(0.0))), 6).alias("coverage"))


@query(f"WITH {joins._FOLIO} SELECT book_id, page, book_offset, printed FROM fs")
def folio_modal_offset(spark, d) -> DataFrame:
    """Each sheet's printed page: as read, else by the book's modal offset, negative ones dropped."""
    return tally.folio(views.sheets(spark, d))


@query(f"""WITH {joins._FOLIO} SELECT book_id, printed AS printed_page, count(*) AS n_sheets, min(page) AS first_sheet FROM fs WHERE printed IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def folio_collisions(spark, d) -> DataFrame:
    """Printed pages, read or computed, that more than one sheet has."""
    f = tally.folio(views.sheets(spark, d)).where("printed is not null")
    return f.groupBy("book_id", F.col("printed").alias("printed_page")).agg(F.count(F.lit(1)).alias("n_sheets"), F.min("page").alias("first_sheet")).where("n_sheets > 1")


@query("""WITH w AS (SELECT book_id, round(size, 1) AS size, sum(length(text)) AS n, min(span_id) AS first FROM spans WHERE size IS NOT NULL AND text IS NOT NULL AND bbox.x1 - bbox.x0 >= 60 AND length(text) >= 20 GROUP BY 1, 2),
m AS (SELECT book_id, size FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, first) AS k FROM w) WHERE k = 1)
SELECT b.book_id, coalesce(m.size, 10.0) AS body_size FROM (SELECT DISTINCT book_id FROM spans) b LEFT JOIN m USING (book_id)""")
def weighted_modal_size(spark, d) -> DataFrame:
    """Body font size of a book: most characters among running lines, first seen on a tie, 10 where none."""
    return tally.modal_size(table(spark, d, "spans"), ["book_id"], "span_id", running=True)


@query("""WITH m AS (SELECT book_id, font, round(size, 1) AS size, span_id FROM spans WHERE regexp_matches(trim(text, ' '), '^[(]?([0-9]{1,3}|[a-zçğıöşü])[.)]$') AND size IS NOT NULL),
s AS (SELECT book_id, size FROM (SELECT book_id, size, row_number() OVER (PARTITION BY book_id ORDER BY count(*) DESC, size) AS k FROM m GROUP BY 1, 2) WHERE k = 1)
SELECT s.book_id, s.size AS marker_size, (SELECT list_sort(list(DISTINCT font)) FROM m WHERE m.book_id = s.book_id AND font IS NOT NULL) AS fonts,
  (SELECT list_sort(list(DISTINCT coalesce(font, '') || '|' || size)) FROM m WHERE m.book_id = s.book_id) AS styles FROM s""")
def marker_calibration(spark, d) -> DataFrame:
    """Modal marker size of a book (smaller on a tie), the fonts of its markers and their styles (font and size), sorted."""
    m = table(spark, d, "spans").where(F.trim("text").rlike("^[(]?([0-9]{1,3}|[a-zçğıöşü])[.)]$") & F.col("size").isNotNull()).select("book_id", "font", F.round("size", 1).alias("size"))
    sizes = m.groupBy("book_id", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("book_id").agg(F.max(F.struct("n", -F.col("size"), "size")).alias("v"))
    style = F.concat(F.coalesce("font", F.lit("")), F.lit("|"), F.col("size").cast("string"))
    fonts = m.groupBy("book_id").agg(F.sort_array(F.collect_set("font")).alias("fonts"), F.sort_array(F.collect_set(style)).alias("styles"))  # a book has few fonts
    return sizes.join(fonts, "book_id").select("book_id", F.col("v.size").alias("marker_size"), "fonts", "styles")


def _faulty(spark, d) -> DataFrame:
    """(region_ord, faulty) of activity regions that break a rule: taller than .7 of the sheet, under 6 points wide or high, or sharing over one square point with another."""
    a = views.activities(spark, d).where("kind = 'activity'").select("book_id", "page", F.col("activity_key").alias("region_ord"), "rect")
    r = F.col("rect")
    odd = a.join(views.sheets(spark, d), ["book_id", "page"]).where((geo.height(r) > 0.7 * F.col("height")) | (geo.width(r) < 6) | (geo.height(r) < 6)).select("region_ord")
    o = a.select("book_id", "page", F.col("region_ord").alias("other"), r.alias("q"))
    shared = a.join(o, ["book_id", "page"]).where((F.col("region_ord") != F.col("other")) & (geo.overlap(r, F.col("q")) > 1)).select("region_ord")
    return odd.unionByName(shared).distinct().withColumn("faulty", F.lit(True))


_BAD = """bad AS (SELECT region_ord FROM rg WHERE rect.y1 - rect.y0 > 0.7 * height OR rect.x1 - rect.x0 < 6 OR rect.y1 - rect.y0 < 6
  UNION SELECT a.region_ord FROM rg a JOIN rg b ON a.book_id = b.book_id AND a.page = b.page AND a.region_ord <> b.region_ord
  WHERE greatest(least(a.rect.x1, b.rect.x1) - greatest(a.rect.x0, b.rect.x0), 0) * greatest(least(a.rect.y1, b.rect.y1) - greatest(a.rect.y0, b.rect.y0), 0) > 1)"""


_FILED = f"""{joins._GREEDY}, {_BAD},
ent AS (SELECT es.*, (SELECT min(page) FROM fs WHERE fs.book_id = es.book_id AND fs.printed = es.printed) AS page FROM es),
gate AS (SELECT book_id, page, entry_ord, CASE WHEN count(*) FILTER (WHERE reason IS NULL) > 0 THEN 'contested'
  ELSE arg_min(reason, CASE reason WHEN 'no-position' THEN 1 WHEN 'confidence-gated' THEN 2 WHEN 'label-mismatch' THEN 3 WHEN 'drift' THEN 4 ELSE 5 END) END AS gate FROM pr GROUP BY 1, 2, 3),
b AS (SELECT ent.book_id, ent.entry_ord, CASE WHEN ent.page IS NULL THEN 'unresolved-page' WHEN l.region_ord IS NOT NULL AND l.region_ord IN (FROM bad) THEN 'rule-violation' WHEN l.region_ord IS NOT NULL THEN 'ok'
    WHEN NOT EXISTS (SELECT 1 FROM rg WHERE rg.book_id = ent.book_id AND rg.page = ent.page) THEN 'page-blank' WHEN posx = 0 AND posy = 0 THEN 'anchor-excluded' ELSE coalesce(gate, 'page-blank') END AS bucket
  FROM ent LEFT JOIN links l ON l.book_id = ent.book_id AND l.page = ent.page AND l.entry_ord = ent.entry_ord LEFT JOIN gate g ON g.book_id = ent.book_id AND g.page = ent.page AND g.entry_ord = ent.entry_ord)"""


@query(f"""{_FILED}
SELECT n.bucket, count(b.entry_ord) AS n FROM (SELECT unnest(['ok', 'rule-violation', 'page-blank', 'anchor-excluded', 'anchor-nogrow', 'contested', 'no-position', 'confidence-gated', 'label-mismatch', 'drift', 'wrong-side', 'page-not-read', 'unresolved-page']) AS bucket) n
LEFT JOIN b USING (bucket) GROUP BY 1""")
def bucket_histogram(spark, d) -> DataFrame:
    """Interactive entries by the cause they are filed under, all 13 causes with their zeros; they sum to the manifest.

    An entry is filed once, on the first sheet of its printed page: linked ones are ok, or rule-violation where their region breaks
    a rule; then page-blank, anchor-excluded (position 0, 0), contested with a candidate, else the first of the gates' reasons.
    The tables hold no anchors, page slices or book confidence, so anchor-nogrow, page-not-read and confidence-gated stay 0.
    """
    return tally.zero_filled(_filed(spark, d), "bucket", tally.BUCKETS)


def _filed(spark, d) -> DataFrame:
    """(book_id, page, entry_ord, bucket) of every interactive entry; page is null where no sheet has its printed page."""
    e, r = joins._placed(spark, d)
    e, keys = reliable(e), ["book_id", "page", "entry_ord"]
    pairs = reliable(matching.gated_pairs(e, r, ["book_id", "page"]).select(*keys, "region_ord", "cost", "reason"))
    linked = joins._links(pairs).join(_faulty(spark, d), "region_ord", "left").select(*keys, F.when(F.col("faulty"), "rule-violation").otherwise("ok").alias("linked"))
    gates = matching.explained(pairs, ["book_id", "page"]).select(*keys, "gate")
    first = e.groupBy("book_id", "printed", "entry_ord").agg(F.min("page").alias("page"))
    own = views.entries(spark, d).where(views.interactive()).select("book_id", F.col("sayfano").alias("printed"), F.col("id").alias("entry_ord"), "posx", "posy")
    filed = own.join(first, ["book_id", "printed", "entry_ord"], "left").join(linked, keys, "left").join(gates, keys, "left")
    bucket = (F.when(F.col("page").isNull(), "unresolved-page").when(F.col("linked").isNotNull(), F.col("linked")).when(F.col("gate").isNull(), "page-blank")
              .when(~views.has_position(), "anchor-excluded").otherwise(F.col("gate")))
    return filed.select(*keys, bucket.alias("bucket"))


@query(f"""WITH {views.SQL}, h AS (SELECT kind, label IS NULL AS bare, list_sort(list(round(rect.y1 - rect.y0, 2))) AS xs FROM act GROUP BY 1, 2)
SELECT kind, bare, xs[least(len(xs) - 1, floor(len(xs) * 0.5)::BIGINT) + 1] AS q50, xs[least(len(xs) - 1, floor(len(xs) * 0.75)::BIGINT) + 1] AS q75,
  xs[least(len(xs) - 1, floor(len(xs) * 0.9)::BIGINT) + 1] AS q90, xs[least(len(xs) - 1, floor(len(xs) * 0.99)::BIGINT) + 1] AS q99, xs[len(xs)] AS top FROM h""")
def nearest_rank_quantiles(spark, d) -> DataFrame:
    """Nearest-rank quantiles of region heights, exact, from distinct values with their counts."""
    a = views.activities(spark, d).select("kind", F.col("label").isNull().alias("bare"), F.round(geo.height(F.col("rect")), 2).alias("v"))
    return tally.nearest_rank(a, ["kind", "bare"], "v", {"q50": 0.5, "q75": 0.75, "q90": 0.9, "q99": 0.99, "top": 1.0})


@query(f"""WITH {views.SQL}, c AS (SELECT book_id, page, count(*) AS n, sum(CASE WHEN rect.y1 - rect.y0 > 0.7 * height THEN 1 ELSE 0 END) AS tall,
  sum(CASE WHEN rect.x1 - rect.x0 < 6 OR rect.y1 - rect.y0 < 6 THEN 1 ELSE 0 END) AS slivers, min(label) AS first_label FROM act JOIN sh USING (book_id, page) GROUP BY 1, 2)
SELECT book_id, sum(n)::BIGINT AS regions, sum(tall)::BIGINT AS tall, sum(slivers)::BIGINT AS slivers, arg_min(coalesce(first_label, '-'), page) AS first_claim FROM c GROUP BY 1""")
def tally_partial_merge(spark, d) -> DataFrame:
    """Page tallies merged per book: counters add, the earliest page's claim stays."""
    a = views.activities(spark, d).join(views.sheets(spark, d), ["book_id", "page"])
    return tally.merge(tally.by_page(a))


@query("""SELECT CASE WHEN ogeturu IS NULL THEN -1 ELSE ogeturu END::BIGINT AS ogeturu, count(*) AS n, count(*) FILTER (WHERE ogeturu = 1 AND length(data) > 0 AND sayfaustuoge AND sayfano <> 0) AS n_interactive,
  count(*) FILTER (WHERE ogeturu = 1 AND length(data) > 0) AS n_loose FROM (SELECT DISTINCT id, ogeturu, data, sayfaustuoge, sayfano FROM publisher_oge) GROUP BY 1""")
def interactive_counts(spark, d) -> DataFrame:
    """Interactive entries by the strict predicate and by the looser one of the catalogue."""
    o = table(spark, d, "publisher_oge").select("id", "ogeturu", "data", "sayfaustuoge", "sayfano").distinct()
    loose = (F.col("ogeturu") == 1) & (F.length("data") > 0)
    return o.groupBy(F.coalesce("ogeturu", F.lit(-1)).cast("long").alias("ogeturu")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(views.interactive()).alias("n_interactive"), F.count_if(loose).alias("n_loose"))


@query("""WITH x AS (SELECT event_type, value, (CAST(json_extract(props, '$.k') AS BIGINT) % 3 = 0) AS y FROM events),
r AS (SELECT event_type, y, (2 * rank() OVER (PARTITION BY event_type ORDER BY value) + count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rk FROM x),
s AS (SELECT event_type, sum(CASE WHEN y THEN rk ELSE 0 END) AS rs, sum(y::INT) AS np, sum((NOT y)::INT) AS nn FROM r GROUP BY 1)
SELECT event_type, round((rs - np * (np + 1) / 2.0) / nullif(np * nn, 0), 6) AS auc FROM s""")
def auc_average_rank(spark, d) -> DataFrame:
    """Area under the ROC curve by average ranks with ties."""
    e = table(spark, d, "events").select("event_type", "value", (F.get_json_object("props", "$.k").cast("long") % 3 == 0).alias("y"))
    return metrics.auc(e, ["event_type"], "value", "y").select("event_type", F.round("auc", 6).alias("auc"))


@query("""WITH p AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) < 50 AS hit, value AS score, event_id FROM events),
c AS (SELECT event_type, hit, sum(hit::INT) OVER w AS tp, row_number() OVER w AS k, sum(hit::INT) OVER (PARTITION BY event_type) AS n FROM p WINDOW w AS (PARTITION BY event_type ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT event_type, tp / n AS recall, max(tp / k) OVER (PARTITION BY event_type ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS env FROM c WHERE n > 0),
q AS (SELECT event_type, t, (SELECT max(env) FROM e WHERE e.event_type = g.event_type AND e.recall >= t / 100.0) AS pr FROM (SELECT DISTINCT event_type FROM p) g, range(0, 101) r(t))
SELECT event_type, round(avg(coalesce(pr, 0)), 6) AS ap FROM q GROUP BY 1""")
def average_precision_101(spark, d) -> DataFrame:
    """Average precision at 101 recall points with the precision envelope; every truth is among the predictions here."""
    p = table(spark, d, "events").select("event_type", (F.get_json_object("props", "$.k").cast("long") < 50).alias("hit"), F.col("value").alias("score"), F.col("event_id").alias("ord"))
    truths = p.groupBy("event_type").agg(F.count_if("hit").alias("truths"))
    return metrics.average_precision(p, truths, ["event_type"]).select("event_type", F.round("ap", 6).alias("ap"))


@query("""WITH g AS (SELECT user_id, event_type, value, event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 5 = 0 AS y FROM events),
k AS (SELECT user_id FROM g GROUP BY 1 HAVING sum(y::INT) = 1 AND count(*) > 1),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM g WHERE user_id IN (SELECT user_id FROM k))
SELECT count(*) AS n_groups, sum(y::INT)::BIGINT AS n_right, round(avg(y::INT), 6) AS accuracy FROM t WHERE rn = 1""")
def top1_single_positive(spark, d) -> DataFrame:
    """How often the best score is the group's only positive, over groups of several rows."""
    g = table(spark, d, "events").select("user_id", F.col("value").alias("score"), F.col("event_id").alias("ord"), (F.get_json_object("props", "$.k").cast("long") % 5 == 0).alias("y"))
    return metrics.top1(g, "user_id").select("n_groups", "n_right", F.round("accuracy", 6).alias("accuracy"))


_BLANK = "[\\s\\p{Z}]"
_SUFFIX = "[\\pL\\pN_]+[a-rt-zçğöşüâîû0-9_](?:iniz|unuz|ünüz)"
_ASKS = f"""length(t) >= {tx.LEAST} AND regexp_matches(t, '^[(\\["''«‘“]?{_BLANK}*[0-9A-Za-zÇĞİÖŞÜÂÎÛçğıöşüâîû]') AND NOT (regexp_matches(t, '^[a-zçğıöşü]') AND NOT regexp_matches(t, '{{inline}}')) AND NOT regexp_matches(f, '^\\s*\\d+\\s*[-–—]\\s*\\d+\\.\\s*sorular')
  AND (t LIKE '%?' OR (contains(t, '?') AND length(t) <= {tx.MOST}) OR regexp_matches(f, '{_SUFFIX}{_BLANK}*(?:[.!?:;]|$)') OR regexp_matches(f, '[\\pL\\pN_]{{{{3,}}}}(?:alim|elim){_BLANK}*(?:[.!?:]|$)')
    OR regexp_matches(f, '[\\pL\\pN_]{{{{2,}}}}(?:ayin|eyin|yin|yun|yün){_BLANK}*[.!?]') OR regexp_matches(f, '^{_BLANK}*(?:now{_BLANK}+)?(?:{'|'.join(tx.ENGLISH_VERBS)})(?:[^\\pL\\pN_]|$)'))"""
_INLINE = f"^\\(?{_BLANK}*([a-zçğıöşü]|\\p{{Nd}}{{1,2}}){_BLANK}*[.)\\]]{_BLANK}+[^\\s\\p{{Z}}]"


@query(f"""WITH l AS (SELECT source, trim(unnest(string_split(text, chr(10))), ' ') AS t FROM documents), x AS (SELECT source, t, replace(lower(replace(t, 'İ', 'i')), 'ı', 'i') AS f FROM l WHERE t <> '')
SELECT source, count(*) AS n_lines, count(*) FILTER (WHERE {_ASKS.replace('{inline}', _INLINE).replace('{{', '{').replace('}}', '}')}) AS n_asks, count(*) FILTER (WHERE regexp_matches(t, '{_INLINE}')) AS n_labelled FROM x GROUP BY 1""")
def question_counts(spark, d) -> DataFrame:
    """Lines of documents that ask for something or open on a label, per source."""
    t = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("t")).select("source", F.trim("t").alias("t")).where("t <> ''")
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(tx.reads_as_question(F.col("t"))).alias("n_asks"), F.count_if(tx.inline_label(F.col("t")).isNotNull()).alias("n_labelled"))


@query("""WITH r AS (SELECT user_id, event_type AS rule, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2)
SELECT user_id, rule, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rule = 'view', n DESC, rule) AS k FROM r) WHERE k = 1""")
def empty_page_attribution(spark, d) -> DataFrame:
    """Modal refusal of each page; a symptom rule only counts where it is alone; ties alphabetical."""
    e = table(spark, d, "events").where("event_type <> 'purchase'").select("user_id", F.col("event_type").alias("rule"))
    return tally.modal_rule(e, ["user_id"], "rule", ["view"])


@query("""WITH x AS (SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, k AS example, event_id, user_id FROM x WHERE k <= 8""")
def triage_examples(spark, d) -> DataFrame:
    """Up to eight examples of each rule, with the rule's count."""
    e = table(spark, d, "events")
    counts = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id")).cast("long")
    return e.withColumn("example", k).where("example <= 8").join(counts, "event_type").select("event_type", "n", "example", "event_id", "user_id")


@query("""SELECT label, count(*) AS n, count(*) - count(DISTINCT vec_id % 100) AS duplicates, max(vec_id) AS last FROM embeddings GROUP BY 1""")
def duplicate_labels(spark, d) -> DataFrame:
    """Repeats beyond the first of each value, per label."""
    return table(spark, d, "embeddings").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct(F.col("vec_id") % 100)).alias("duplicates"), F.max("vec_id").alias("last"))


@query(f"""WITH {views.SQL}, t AS (SELECT id, title, CASE WHEN regexp_matches(b, 'ingilizce|english') THEN 'elt' WHEN regexp_matches(b, 'soru|test|alistirma') THEN 'questions' ELSE 'subject' END AS template
  FROM (SELECT DISTINCT id, baslik AS title, lower(translate(baslik, 'İIıŞşĞğÇçÖöÜüÂâÎîÛû', 'iiissggccoouuaaiiuu')) AS b FROM kitap))
SELECT template, count(DISTINCT id) AS n_books FROM t GROUP BY 1""")
def book_templates(spark, d) -> DataFrame:
    k = table(spark, d, "kitap").select("id", "baslik").distinct()
    return k.groupBy(tx.template_of(F.col("baslik")).alias("template")).agg(F.countDistinct("id").alias("n_books"))


@query("""SELECT width, height, n FROM (SELECT round(width, 2) AS width, round(height, 2) AS height, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, round(width, 2), round(height, 2)) AS k FROM sheets WHERE width IS NOT NULL GROUP BY 1, 2) WHERE k = 1""")
def most_common_size(spark, d) -> DataFrame:
    s = table(spark, d, "sheets").where("width is not null").groupBy(F.round("width", 2).alias("width"), F.round("height", 2).alias("height")).agg(F.count(F.lit(1)).alias("n"))
    return s.orderBy(F.desc("n"), "width", "height").limit(1)
