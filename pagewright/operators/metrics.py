"""Detection and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.operators.prefix import running_sum


def auc(rows: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Mann-Whitney AUC with average ranks per ``keys``; null where a class is missing.

    Scores are counted first; the running count over distinct scores is range-partitioned, so one key may hold them all.
    """
    c = rows.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("p"))
    run = running_sum(c, [*keys, score], "n", "_upto")
    s = run.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2)).alias("rs"), F.min(F.col("_upto") - F.col("n")).alias("_before"),
                               F.sum("p").alias("np"), F.sum(F.col("n") - F.col("p")).alias("nn"))
    return s.select(*keys, ((F.col("rs") - F.col("_before") * F.col("np") - F.col("np") * (F.col("np") + 1) / 2) / F.nullif(F.col("np") * F.col("nn"), F.lit(0))).alias("auc"))


def average_precision(pred: DataFrame, truths: DataFrame, keys: list[str], points: int = 101) -> DataFrame:
    """Interpolated average precision of (keys, score, ord, hit) against (keys, truths); null where there is no truth.

    Hits and ranks are running sums over one global range sort, so a class may hold all rows; what follows has at most
    ``points`` rows a class.
    """
    rows = pred.withColumns({"_down": -F.col("score"), "_one": F.lit(1), "_hit": F.coalesce(F.col("hit"), F.lit(False)).cast("int")})
    run = running_sum(rows, [*keys, "_down", "ord"], "_hit", "_tp", {"_one": "_rank"})
    start = run.groupBy(*keys).agg(F.min(F.col("_tp") - F.col("_hit")).alias("_tp0"), F.min(F.col("_rank") - 1).alias("_rank0")).join(truths.where("truths > 0"), keys)
    own = run.join(start, keys).withColumns({"_tp": F.col("_tp") - F.col("_tp0"), "_rank": F.col("_rank") - F.col("_rank0")})
    # A row holds for every point up to its recall; the greatest precision per last point is enough, its suffix maximum is the envelope.
    last = F.floor(F.col("_tp") * (points - 1) / F.col("truths")).cast("int")
    best = own.groupBy(*keys, last.alias("_last")).agg(F.max(F.col("_tp") / F.col("_rank")).alias("_v"))
    w = W.partitionBy(*keys).orderBy(F.desc("_last"))
    upper = F.max("_v").over(w.rowsBetween(W.unboundedPreceding, 0))
    spans = best.withColumns({"_take": F.col("_last") - F.coalesce(F.lead("_last").over(w), F.lit(-1)), "_v": upper})
    summed = spans.groupBy(*keys).agg((F.sum(F.col("_take") * F.col("_v")) / points).alias("_ap"))
    return truths.join(summed, keys, "left").select(*keys, F.when(F.col("truths") > 0, F.coalesce("_ap", F.lit(0.0))).alias("ap"))


def top1(rows: DataFrame, group: str) -> DataFrame:
    """(n_groups, n_right, accuracy) over groups with one positive and several rows; the first row wins a tie."""
    g = rows.groupBy(group).agg(F.count_if("y").alias("p"), F.count(F.lit(1)).alias("n"), F.max(F.struct("score", -F.col("ord"), "y")).alias("best")).where("p = 1 and n > 1")
    right = F.col("best.y").cast("int")
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.sum(right).alias("n_right"), F.avg(right).alias("accuracy"))


def contested(rows: DataFrame, group: str, rival) -> DataFrame:
    """Rows of the groups in which more than one row is a ``rival``."""
    return rows.join(rows.groupBy(group).agg(F.count_if(rival).alias("_n")).where("_n > 1").select(group), group, "left_semi")


def shares(rows: DataFrame, value: str, points: dict[str, float]) -> DataFrame:
    """(n, name...): the share of rows with at least each point's value, three decimals; null values count as less, no rows give nulls."""
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.coalesce((F.col(value) >= x), F.lit(False)).cast("int")), 3).alias(name) for name, x in points.items()])


def jaccard(a, b):
    """Shared part of two sets; two empty ones are equal."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / whole)
