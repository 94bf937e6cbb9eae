"""Deterministic splits, samples, rankings and budgets; all random choices are in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.operators.prefix import numbered


def every_third(rows: DataFrame, strata: list[str], order: str) -> DataFrame:
    """``rows`` with ``held_out``: the second of each three of a stratum in ``order``; strata are few and may be hot, so rows are numbered over a range sort."""
    n = numbered(rows, strata, [order], "_n")
    return n.withColumn("held_out", (F.col("_n") - 1) % 3 == 1).drop("_n")


def hash_order(*cols: str, seed: str = "1") -> Column:
    """A stable pseudo-random order that other engines can repeat (MD5 of the seed and the values)."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def quota_sample(rows: DataFrame, book: str, stratum: str, key: str, total: int, shares: dict[str, float], first: str, order: list[str]) -> DataFrame:
    """Per book ``total`` rows with ``shares`` of the strata (``first`` takes the remainder), topped up in ``order`` where a stratum is short.

    Rows are numbered within the stratum over a range sort; a window then ranks what the quotas left over.
    """
    quota = {s: int(total * x) for s, x in shares.items()}
    quota[first] = total - sum(v for s, v in quota.items() if s != first)
    ranked = numbered(rows.withColumn("_h", hash_order(book, key)), [book, stratum], ["_h", key], "_k")
    limit, place = F.lit(0), F.lit(len(order))
    for s, v in quota.items():
        limit = F.when(F.col(stratum) == s, v).otherwise(limit)
    for i, s in enumerate(order):
        place = F.when(F.col(stratum) == s, i).otherwise(place)
    by_quota = F.col("_k") <= limit
    # of a stratum no row beyond the total-th can be taken, so the second window sees at most strata x total rows a book
    near = ranked.where(F.col("_k") <= total)
    then = W.partitionBy(book).orderBy(F.when(by_quota, 0).otherwise(1), place, "_h", key)
    return near.withColumn("topped_up", ~by_quota).withColumn("_r", F.row_number().over(then)).where(F.col("_r") <= total).drop("_h", "_k", "_r")


def doubt(score: Column) -> Column:
    """1 at .5, falling to 0 at the sure ends (.05 and .95 on)."""
    return F.greatest(F.lit(0.0), F.when(score >= 0.5, 1 - (score - 0.5) / 0.4).otherwise(1 - (0.5 - score) / 0.5))


def systematic(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Every k-th of the rows in ``order``, k = max(1, rows // n), at most n, by the global rank over a range sort."""
    ranked = numbered(rows, [], [order], "_rank")
    k = max(1, ranked.count() // n)
    return ranked.where(((F.col("_rank") - 1) % k == 0) & (F.col("_rank") <= F.lit(k) * n)).drop("_rank")


def page_doubt(scores: Column) -> Column:
    """The greatest doubt of a page's boxes, 0 without any."""
    return F.coalesce(F.array_max(F.transform(scores, doubt)), F.lit(0.0))


def sure_boxes(boxes: Column, conf: float) -> Column:
    """A page's kept boxes (structs with a score) if all are at least ``conf`` sure, else null; a page without boxes is sure."""
    return F.when(F.forall(boxes, lambda b: b["score"] >= conf), boxes)


def self_labels(pages: DataFrame, book: str, page: str, empty: str, cap: int, empty_share: float, seed: str = "1") -> DataFrame:
    """At most ``cap`` pages a book in hash order, of which at most ``empty_share`` without boxes (column ``empty``)."""
    few = int(cap * empty_share)
    ranked = numbered(pages.withColumn("_h", hash_order(book, page, seed=seed)), [book, empty], ["_h", page], "_k").where((~F.col(empty) & (F.col("_k") <= cap)) | (F.col("_k") <= few))
    w = W.partitionBy(book).orderBy(F.desc(empty), "_h", page)  # at most two caps of rows a book
    return ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_h", "_k", "_r")


def fraction(rows: DataFrame, keys: list[str], key: str, share: float, seed: str = "1") -> DataFrame:
    """``share`` of each group's rows in hash order, rounded half to even, one at least."""
    n = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * share)).alias("_n"))
    return numbered(rows.withColumn("_h", hash_order(*keys, key, seed=seed)), keys, ["_h", key], "_k").join(n, keys).where(F.col("_k") <= F.col("_n")).drop("_h", "_k", "_n")


def asked_next(pages: DataFrame, asked: DataFrame, held_out: DataFrame, book: str, page: str, most: int = 38) -> DataFrame:
    """The next pages to ask of each book: not asked yet, not of held-out books, those with missing icons first, then by doubt, ``most`` of them, in page order with ``place``."""
    free = pages.join(asked.select(book, page), [book, page], "left_anti").join(held_out.select(book), book, "left_anti")
    w = W.partitionBy(book).orderBy(F.desc(F.least("missing", F.lit(1))), F.desc("doubt"), page)
    best = free.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
    return best.withColumn("place", F.row_number().over(W.partitionBy(book).orderBy(page)))


def chunks(books: DataFrame, size: int = 80) -> DataFrame:
    """(book_id, first, last, place) of slices of at most ``size`` pages, the largest first, then by book and page."""
    starts = F.explode(F.sequence(F.lit(1), F.col("pages"), F.lit(size))).alias("first")
    c = books.where("pages > 0").select("book_id", "pages", starts).withColumn("last", F.least(F.col("first") + size - 1, F.col("pages"))).drop("pages")
    return numbered(c.withColumn("_less", -(F.col("last") - F.col("first"))), [], ["_less", "book_id", "first"], "place").drop("_less")


def interleaved(books: DataFrame) -> DataFrame:
    """``books`` (book_id, pages) with ``place``: the largest, the smallest, the second largest, ... so that large ones do not run together."""
    n = books.count()
    r = numbered(books.withColumn("_less", -F.col("pages")), [], ["_less", "book_id"], "_r")
    return r.withColumn("place", F.when(F.col("_r") * 2 <= n + 1, F.col("_r") * 2 - 1).otherwise((F.lit(n) - F.col("_r") + 1) * 2)).drop("_less", "_r")
