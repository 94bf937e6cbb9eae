"""Scores of predicted boxes against a teacher's: average precision over overlap steps, precision and recall, per book and in total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.matching import match_detections
from pagewright.operators.metrics import average_precision
from pagewright.session import reliable

#: Overlaps at which average precision is taken.
STEPS = tuple(k / 100 for k in range(50, 100, 5))
TOTAL = "total"


def scores(pages: DataFrame, pred: DataFrame, truth: DataFrame, conf: float = 0.5, book: str = "book_id", page: str = "page") -> DataFrame:
    """One row a book and one for all (``scope``): pages, boxes, map50, map50_95, precision, recall and empty pages.

    ``pages`` lists every page judged; boxes have (book, page, ord, x0..y1), predictions a score. Average precision takes all
    predictions, precision and recall those from ``conf`` on at overlap .5; it is computed anew for the total, not averaged. Without
    teacher boxes the averages and recall are null, without predictions precision is. A page counts as empty without teacher boxes.
    """
    keys = [book, page]
    hits = reliable(match_detections(pred.select(*keys, "ord", "score", "x0", "y0", "x1", "y1"), truth, keys, STEPS).select(*keys, "ord", "score", "hits"))
    scope = F.explode(F.array(F.col(book).cast("string"), F.lit(TOTAL))).alias("scope")
    n_truth = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_truth"))
    sure = hits.where(F.col("score") >= conf).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"), F.count_if(F.col("hits")[0]).alias("n_hit"))
    per_page = pages.select(*keys).distinct().join(n_truth, keys, "left").join(sure, keys, "left").fillna(0, ["n_truth", "n_pred", "n_hit"])
    counts = per_page.select(scope, "n_truth", "n_pred", "n_hit").groupBy("scope").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n_truth").alias("teacher_boxes"), F.sum("n_pred").alias("predicted_boxes"), F.sum("n_hit").alias("n_hit"),
        F.count_if(F.col("n_truth") == 0).alias("empty_pages"), F.count_if((F.col("n_truth") == 0) & (F.col("n_pred") > 0)).alias("empty_pages_with_a_box"))
    step = F.posexplode("hits").alias("step", "hit")
    ranked = hits.select(scope, "score", F.struct(*keys, "ord").alias("ord"), "hits").select("scope", "score", "ord", step)
    truths = counts.select("scope", F.col("teacher_boxes").alias("truths"), F.explode(F.sequence(F.lit(0), F.lit(len(STEPS) - 1))).alias("step"))
    ap = average_precision(ranked, truths, ["scope", "step"]).groupBy("scope").agg(F.max(F.when(F.col("step") == 0, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))
    share = {"precision": F.col("n_hit") / F.nullif(F.col("predicted_boxes"), F.lit(0)), "recall": F.col("n_hit") / F.nullif(F.col("teacher_boxes"), F.lit(0))}
    return counts.join(ap, "scope").select("scope", "pages", "teacher_boxes", "predicted_boxes", *[F.round(c, 4).alias(c) for c in ("map50", "map50_95")],
                                           *[F.round(v, 4).alias(k) for k, v in share.items()], "empty_pages", "empty_pages_with_a_box")
