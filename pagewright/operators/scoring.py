"""Scores of a book's regions against the rules and the publisher's manifest: page tallies, their merge, rows, totals and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as geo
from pagewright.operators import labels, tally

KEYS = ["book_id", "page"]
#: Counters of a page; a book's are their sums.
COUNTERS = ("regions", "parts", "questions", "empty_regions", "pages_with_regions", "markers", "markers_in_region", "panels_cut", "solutions_cut", "solutions_covered", "solutions_total", "panels_total",
            "off_sheet_solutions", "tall", "slivers", "overlaps", "anchored", "oges_seen", "oges_on_blank_pages")
#: Counters that are also kept for the parts of regions grown from an icon.
FROM_ANCHORS = ("panels_cut", "solutions_cut", "tall", "slivers", "overlaps")


def page_tallies(sheets: DataFrame, regions: DataFrame, parts: DataFrame, blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """The 19 counters of every sheet of ``sheets`` (book_id, page, width, height), and five of them again for parts of anchored regions.

    ``regions`` has (book_id, page, id, n_items, anchored, bound), of which the last two may be null; ``parts`` (book_id, page, ord, anchored, rect), a
    region without parts brings its own box; ``blocks`` (book_id, page, kind, ord, rect) of kinds panel, solution and marker;
    ``entries`` (book_id, page) one row an entry and sheet. All joins are on the sheet; counters are null-free.
    """
    r, size = F.col("rect"), sheets.select(*KEYS, "width", "height")
    held = regions.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("regions"), F.sum(F.coalesce("n_items", F.lit(0))).alias("questions"), F.count_if(F.coalesce("n_items", F.lit(0)) == 0).alias("empty_regions"),
                                      F.count_if(F.coalesce("bound", F.lit(False))).alias("anchored"))
    own = parts.withColumn("_a", F.coalesce("anchored", F.lit(False)))
    tall, thin = geo.height(r) > labels.TALL * F.col("height"), (geo.height(r) < labels.THIN) | (geo.width(r) < labels.THIN)
    shape = own.join(size, KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("parts"), F.count_if(tall).alias("tall"), F.count_if(thin).alias("slivers"),
                                                    F.count_if(tall & F.col("_a")).alias("tall_anchored"), F.count_if(thin & F.col("_a")).alias("slivers_anchored"))
    other = own.select(*KEYS, F.col("ord").alias("_o"), r.alias("_q"), F.col("_a").alias("_b"))
    over = own.join(other, KEYS).where((F.col("ord") < F.col("_o")) & (geo.overlap(r, F.col("_q")) > 1)).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("overlaps"), F.count_if(F.col("_a") | F.col("_b")).alias("overlaps_anchored"))
    cut = labels.cut_counts(own.select(*KEYS, "rect", "_a"), blocks, sheets, [*KEYS, "_a"]).groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in ("panels_cut", "solutions_cut")], *[F.sum(F.when(F.col("_a"), F.col(c)).otherwise(0)).alias(f"{c}_anchored") for c in ("panels_cut", "solutions_cut")])
    b = blocks.join(size, KEYS).withColumn("_on", (r["x0"] >= -2) & (r["y0"] >= -2) & (r["x1"] <= F.col("width") + 2) & (r["y1"] <= F.col("height") + 2))
    seen = b.groupBy(*KEYS).agg(F.count_if(F.col("kind") == "marker").alias("markers"), F.count_if(F.col("kind") == "panel").alias("panels_total"),
                                F.count_if((F.col("kind") == "solution") & F.col("_on")).alias("solutions_total"), F.count_if((F.col("kind") == "solution") & ~F.col("_on")).alias("off_sheet_solutions"))
    touched = b.where("kind <> 'panel'").withColumnRenamed("ord", "_ord").join(own.select(*KEYS, r.alias("_q")), KEYS)
    inside = F.when(F.col("kind") == "marker", geo.overlap(F.col("_q"), r) > 0).otherwise(F.col("_on") & (geo.overlap(F.col("_q"), r) >= 0.5 * geo.area(r)))
    got = touched.where(inside).select(*KEYS, "kind", "_ord").distinct().groupBy(*KEYS).agg(F.count_if(F.col("kind") == "marker").alias("markers_in_region"), F.count_if(F.col("kind") == "solution").alias("solutions_covered"))
    asked = entries.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("oges_seen"))
    out = sheets.select(*KEYS)
    for part in (held, shape, over, cut, seen, got, asked):
        out = out.join(part, KEYS, "left")
    out = out.fillna(0)
    out = out.withColumns({"pages_with_regions": (F.col("regions") > 0).cast("long"), "oges_on_blank_pages": F.when(F.col("regions") == 0, F.col("oges_seen")).otherwise(F.lit(0))})
    return out.select(*KEYS, *COUNTERS, *[f"{c}_anchored" for c in FROM_ANCHORS])


def merged(pages: DataFrame) -> DataFrame:
    """Page tallies of a book as one: every counter adds, in whatever slices the pages came; ``pages`` is their number."""
    return pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(c).alias(c) for c in (*COUNTERS, *[f"{c}_anchored" for c in FROM_ANCHORS])])


def claims(filed: DataFrame) -> DataFrame:
    """(book_id, entry_ord, bucket) of entries filed page by page: the earliest page's claim stays."""
    return filed.groupBy("book_id", "entry_ord").agg(F.min_by("bucket", F.struct("page", "bucket")).alias("bucket"))


def _rate(a: Column, b: str) -> Column:
    return F.round(a / F.nullif(F.col(b), F.lit(0)), 3)


def book_rows(books: DataFrame, buckets: DataFrame) -> DataFrame:
    """One row a book: shares of the merged counters, and the entries of each bucket as a column, zeros included.

    Shares without a denominator are 0, but the match rate and the solutions' coverage null: nothing there was to be found.
    """
    wide = buckets.groupBy("book_id").pivot("bucket", list(tally.BUCKETS)).count().fillna(0)
    j = books.join(wide, "book_id", "left").fillna(0, list(tally.BUCKETS))
    oges = sum((F.col(f"`{b}`") for b in tally.BUCKETS), F.lit(0))
    return j.withColumns({
        "oges": oges, "blank_page_share": F.coalesce(F.round(1 - F.col("pages_with_regions") / F.nullif(F.col("pages"), F.lit(0)), 3), F.lit(0.0)),
        "empty_region_share": F.coalesce(_rate(F.col("empty_regions"), "regions"), F.lit(0.0)), "match_rate": F.round(F.col("ok") / F.nullif(oges, F.lit(0)), 3),
        "markers_outside": F.col("markers") - F.col("markers_in_region"), "solution_coverage": _rate(F.col("solutions_covered"), "solutions_total")})


def carried_by_anchor(regions: DataFrame) -> DataFrame:
    """Sheets all of whose regions were grown from icons (their id names the entry)."""
    return regions.groupBy(*KEYS).agg(F.bool_and(F.contains("id", F.lit("-oge-"))).alias("_all")).where("_all").select(*KEYS)


def evaluation(scores: DataFrame) -> DataFrame:
    """Totals of score rows (with ``tally.rates``'s columns): sums, rates from the sums, and the loss as plain mean over books, infinite without any."""
    s = {c: F.sum(c) for c in ("pages", "regions", "oges", "matched", "panels_cut", "solutions_cut", "overlaps", "tall", "slivers", "pages_with_regions")}
    t = scores.agg(F.count(F.lit(1)).alias("books"), *[F.coalesce(v, F.lit(0)).alias(k) for k, v in s.items()], F.coalesce(F.avg("loss"), F.lit(float("inf"))).alias("loss"))
    return t.withColumns({"cut_rate": (F.col("panels_cut") + F.col("solutions_cut")) / F.nullif(F.col("regions"), F.lit(0)), "match_rate": F.col("matched") / F.nullif(F.col("oges"), F.lit(0)),
                          "coverage": F.col("pages_with_regions") / F.nullif(F.col("pages"), F.lit(0))})


def compared(now: DataFrame, before: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``now`` beside ``before``: each value, the earlier one and the difference; a key that only one side has keeps nulls on the other."""
    b = before.select(*keys, *[F.col(v).alias(f"{v}_before") for v in values])
    j = now.select(*keys, *values).join(b, keys, "full")
    return j.withColumns({f"{v}_delta": F.col(v) - F.col(f"{v}_before") for v in values})


def mark(value: Column, limit: Column, at_most: bool = True) -> Column:
    """PASS, FAIL or NOT MEASURED; what was not measured did not pass."""
    ok = value <= limit if at_most else value >= limit
    return F.when(value.isNull() | limit.isNull(), "NOT MEASURED").when(ok, "PASS").otherwise("FAIL")


def delta_text(now: Column, before: Column, digits: int = 1) -> Column:
    """'12.3 (+0.4)', without brackets where there is no earlier value, '-' where there is none at all."""
    d = now - before
    sign = F.when(d >= 0, "+").otherwise("-")
    plain = F.format_number(now, digits)
    return F.when(now.isNull(), "-").when(before.isNull(), plain).otherwise(F.concat(plain, F.lit(" ("), sign, F.format_number(F.abs(d), digits), F.lit(")")))


def baked_scores(regions: DataFrame, diagnostics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, refused) books of (book_id, fingerprint) region documents: one needs the diagnostics of the same fingerprint; the reason is given."""
    d = diagnostics.select("book_id", F.col("fingerprint").alias("_f")).groupBy("book_id").agg(F.collect_set("_f").alias("_fs"))  # a book has one
    j = regions.join(d, "book_id", "left")
    why = F.when(F.col("_fs").isNull(), "no diagnostics").when(~F.array_contains("_fs", F.col("fingerprint")), "diagnostics are stale")
    j = j.withColumn("why", why)
    return j.where("why is null").drop("why", "_fs"), j.where("why is not null").select("book_id", "why")
