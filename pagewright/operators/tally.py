"""Partial and final tallies, votes, nearest-rank quantiles, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import geometry as geo

# The causes that an entry is filed under.
BUCKETS = ("ok", "rule-violation", "page-blank", "anchor-excluded", "anchor-nogrow", "contested", "no-position", "confidence-gated",
           "label-mismatch", "drift", "wrong-side", "page-not-read", "unresolved-page")
#: Weights of the loss.
LOSS = {"cut": 100, "overlap": 200, "tall": 40, "sliver": 40, "miss": 20, "coverage": -1}


def rates(scores: DataFrame) -> DataFrame:
    """Rates of score rows: null where the denominator is 0, which the loss takes as 0; without entries no miss is paid."""
    def rate(a: Column, b: str) -> Column:
        return a / F.nullif(F.col(b), F.lit(0))

    cut = rate(F.col("panels_cut") + F.col("solutions_cut"), "regions")
    match, cover = rate(F.col("matched"), "oges"), rate(F.col("pages_with_regions"), "pages")
    zero = F.lit(0.0)
    loss = (LOSS["cut"] * F.coalesce(cut, zero) + LOSS["overlap"] * F.coalesce(rate(F.col("overlaps"), "regions"), zero) + LOSS["tall"] * F.coalesce(rate(F.col("tall"), "regions"), zero)
            + LOSS["sliver"] * F.coalesce(rate(F.col("slivers"), "regions"), zero) + F.when(F.col("oges") > 0, LOSS["miss"] * (1 - match)).otherwise(zero) + LOSS["coverage"] * F.coalesce(cover, zero))
    return scores.withColumns({"cut_rate": cut, "match_rate": match, "coverage": cover, "loss": loss})


def by_page(regions: DataFrame) -> DataFrame:
    """One tally a sheet of (book_id, page, rect, label, height): the partial of ``merge``."""
    r = F.col("rect")
    tall = geo.height(r) > 0.7 * F.col("height")
    sliver = (geo.width(r) < 6) | (geo.height(r) < 6)
    return regions.groupBy("book_id", "page").agg(
        F.count(F.lit(1)).alias("regions"), F.count_if(tall).alias("tall"), F.count_if(sliver).alias("slivers"), F.min("label").alias("claim"))


def merge(pages: DataFrame) -> DataFrame:
    """Page tallies of a book as one: counters add, the claim of the earliest page stays."""
    return pages.groupBy("book_id").agg(*[F.sum(c).alias(c) for c in ("regions", "tall", "slivers")],
                                        F.min_by(F.coalesce("claim", F.lit("-")), "page").alias("first_claim"))


def zero_filled(rows: DataFrame, col: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of ``col`` for each of ``values``, with zeros."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(v,) for v in values], f"{col} string")
    counts = rows.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, col, "left").select(col, F.coalesce("n", F.lit(0)).alias("n"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """s[min(n - 1, floor(n * f))] of the sorted values of each group, null values left out.

    Values are counted first, so the running count goes over distinct values and a hot group is pre-aggregated.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy(value))
    run = counted.withColumn("_upto", upto).join(totals, keys)
    rank = {name: F.least(F.col("_all") - 1, F.floor(F.col("_all") * f)) for name, f in points.items()}
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > r, F.col(value))).alias(name) for name, r in rank.items()])


def folio(sheets: DataFrame, first: int | None = None) -> DataFrame:
    """(book_id, page, book_offset, printed) by a vote on sheet minus printed page: most votes, smaller distance, first seen.

    Only the ``first`` sheets vote and count as read where given. A book without votes has the offset 0; what comes out negative is null.
    """
    read = sheets.where("printed_page is not null") if first is None else sheets.where(F.col("printed_page").isNotNull() & (F.col("page") <= first))
    votes = read.groupBy("book_id", (F.col("page") - F.col("printed_page")).alias("off")).agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first"))
    best = votes.groupBy("book_id").agg(F.max(F.struct("n", -F.abs("off"), -F.col("first"), "off")).alias("v")).select("book_id", F.col("v.off").alias("book_offset"))
    out = sheets.join(best, "book_id", "left").withColumn("book_offset", F.coalesce("book_offset", F.lit(0)))
    guess = F.col("page") - F.col("book_offset")
    seen = F.col("printed_page") if first is None else F.when(F.col("page") <= first, F.col("printed_page"))
    return out.select("book_id", "page", "book_offset", F.coalesce(seen, F.when(guess >= 0, guess)).alias("printed"))


def modal_size(spans: DataFrame, keys: list[str], ordinal: str, running: bool = False, fallback: float = 10.0) -> DataFrame:
    """Font size (one decimal) with most characters per ``keys``, the first seen on a tie; ``running`` keeps lines of text."""
    s = spans.where("size is not null and text is not null")
    if running:
        s = s.where((geo.width(F.col("bbox")) >= 60) & (F.length("text") >= 20))
    sums = s.groupBy(*keys, F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min(ordinal).alias("first"))
    best = sums.groupBy(*keys).agg(F.max(F.struct("n", -F.col("first"), "size")).alias("v")).select(*keys, F.col("v.size").alias("body_size"))
    return spans.select(*keys).distinct().join(best, keys, "left").fillna({"body_size": fallback})


def modal_rule(rows: DataFrame, keys: list[str], rule: str, symptoms: list[str]) -> DataFrame:
    """The most frequent rule of each group; symptoms only win alone; ties go to the alphabet."""
    n = rows.groupBy(*keys, rule).agg(F.count(F.lit(1)).alias("n"))
    best = W.partitionBy(*keys).orderBy(F.col(rule).isin(symptoms), F.desc("n"), rule)
    return n.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
