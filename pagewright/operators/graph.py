"""Connected components of rectangles and other small islands by spreading the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import release, reliable, written


def min_label(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, label): the smallest vertex of each component of (u, v) edges.

    Each round takes the smallest label around and then the label's own label, so long chains halve; it ends when no
    label changes. Vertices without edges keep themselves.
    """
    both = reliable(edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select("v", "u")).distinct())
    labels = written(vertices.select(F.col(vertices.columns[0]).alias("vertex")).distinct().withColumn("label", F.col("vertex")))
    while True:
        around = both.join(labels.select(F.col("vertex").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near")).withColumnRenamed("v", "vertex")
        seen = labels.join(around, "vertex", "left").select("vertex", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("vertex").alias("label"), F.col("label").alias("far"))
        before, labels = labels, written(seen.join(jump, "label", "left").select("vertex", "was", F.least("label", "far").alias("label")))
        release(before)
        if labels.where("was <> label").isEmpty():
            return labels.drop("was")
