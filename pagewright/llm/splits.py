"""Train, validation and test splits that keep related records together.

Components of the record-code graph come from random-mate contraction: each round every vertex flips a
seeded coin, tails collapse into a head neighbour by joins, and the edges are relabelled, until none is left; the
rounds' maps are then unwound to labels. Components are split by cumulative weight.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.keys import guid
from pagewright.operators.prefix import running_sum
from pagewright.operators.skew import salted_join
from pagewright.session import release, reliable, table, written


def _heads(v: str) -> Column:
    return F.pmod(F.xxhash64("turn", v), F.lit(2)) == 1


def components(edges: DataFrame) -> DataFrame:
    """(vertex, label) of every vertex of ``edges`` (u, v): equal labels exactly within a component.

    Edges with a null end and loops join nothing. A star of any size costs one row an edge; hot vertices are salted
    in the relabelling joins and pre-aggregated in the choice of a neighbour. The round's number is a column, so that
    all rounds share one plan and its compiled code. Each vertex collapses once, so the maps of all rounds are one
    forest; it is unwound by doubling, in as many joins as its depth has binary digits.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "turn").distinct()

    first = left = written(tidy(edges.select("u", "v", F.lit(0).alias("turn"))))
    maps = []
    while n := left.count():
        ways = left.select("u", "v", "turn").union(left.select("v", "u", "turn")).where(~_heads("u") & _heads("v"))
        collapsed = written(ways.groupBy("u").agg(F.min("v").alias("parent")))
        maps.append(collapsed)
        moved = left
        for end in ("u", "v"):
            # many rounds: a broadcast each would pile up on the driver
            to = collapsed.withColumnsRenamed({"u": end, "parent": "_to"}).hint("merge")
            moved = salted_join(moved, to, [end], "left", rows=n).select(*[F.coalesce("_to", c).alias(c) if c == end else F.col(c) for c in ("u", "v", "turn")])
        before, left = left, written(tidy(moved.withColumn("turn", F.col("turn") + 1)))
        if before is not first:
            release(before)
    vertices = first.select(F.col("u").alias("vertex")).union(first.select("v")).distinct()
    if not maps:
        return vertices.withColumn("label", F.col("vertex"))
    forest = written(reduce(DataFrame.union, maps))
    release(*maps)
    n, depth = forest.count(), 1
    while depth < len(maps):
        up = forest.select(F.col("u").alias("parent"), F.col("parent").alias("_up")).hint("merge")
        before, forest = forest, written(salted_join(forest, up, ["parent"], "left", rows=n).select("u", F.coalesce("_up", "parent").alias("parent")))
        release(before)
        depth *= 2
    labels = forest.select(F.col("u").alias("vertex"), F.col("parent").alias("label"))
    return vertices.join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))


def code(col: str) -> Column:
    """A code without regard to case and outer blanks; null, empty and '-' are null."""
    plain = F.lower(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""))
    return F.when((plain != "") & (plain != "-"), plain)


def record_groups(records: DataFrame, key: str, codes: dict[str, str]) -> DataFrame:
    """(record, group) of every record: records that share a code of the same kind, directly or through others, share the group.

    ``codes`` maps kinds to columns that already hold canonical codes or null. Rows with a null key are dropped; a
    record without codes is its own group; repeated rows change nothing.
    """
    named = records.where(F.col(key).isNotNull())
    edges = None
    for kind, col in codes.items():
        e = named.where(F.col(col).isNotNull()).select(F.concat(F.lit("record "), F.col(key)).alias("u"), F.concat(F.lit(f"{kind} "), F.col(col)).alias("v"))
        edges = e if edges is None else edges.union(e)
    labels = components(edges).where(F.startswith("vertex", F.lit("record "))).select(F.expr("substr(vertex, 8)").alias("record"), "label")
    every = named.select(F.col(key).alias("record")).distinct()
    return every.join(labels, "record", "left").select("record", F.coalesce("label", F.concat(F.lit("record "), "record")).alias("group"))


def assign_splits(weights: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """(group, weight, split) for (group, weight): each group whole, the splits' weights near their shares.

    Groups are laid end to end by size class (powers of two, largest first) and in hash order within one; each class is cut
    at its cumulative weight in proportion to what the larger ones left missing of each share, so small classes make up for
    the whole groups at larger cuts. A group of weight up to 0 costs nothing and goes by its place. No split is off by more than the
    largest group. Shares are scaled to sum to 1. A class's sums are the only thing that reaches the driver: three numbers a
    split, of at most 63 classes.
    """
    shares = {s: max(0.0, float(x or 0)) for s, x in sorted(targets)}
    whole = sum(shares.values())
    if not whole:
        return weights.withColumn("split", F.lit(None).cast("string"))
    size = F.when(F.col("weight") >= 1, F.floor(F.log2("weight"))).otherwise(-1)
    laid = running_sum(weights.select("group", "weight").withColumns({"_size": size.cast("int"), "_h": F.xxhash64("group")}), ["_size", "_h", "group"], "weight")
    laid = reliable(laid.withColumn("_middle", F.col("running") - F.col("weight") / 2))
    classes = {r["_size"]: (float(r.w), float(r.upto)) for r in laid.groupBy("_size").agg(F.sum("weight").alias("w"), F.max("running").alias("upto")).collect()}
    total = sum(w for w, _ in classes.values())
    missing = {s: x / whole * total for s, x in shares.items()}
    split = F.lit(None).cast("string")
    for k in sorted(classes, reverse=True):
        w, upto = classes[k]
        wanted = {s: m for s, m in missing.items() if m > 0} or {max(missing, key=missing.get): 1.0}
        own, at, last = None, upto - w, list(wanted)[-1]
        for s, m in wanted.items():
            at += m / sum(wanted.values()) * w
            if s != last:
                own = F.when(F.col("_middle") <= at, s) if own is None else own.when(F.col("_middle") <= at, s)
        own = F.lit(last) if own is None else own.otherwise(last)
        for r in laid.where(F.col("_size") == k).groupBy(own.alias("split")).agg(F.sum("weight").alias("w")).collect():
            missing[r.split] -= float(r.w or 0)
        split = F.when(F.col("_size") == k, own).otherwise(split)
    return laid.select("group", "weight", split.alias("split"))


def book_groups(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cleaned score rows and the group of each book."""
    plain = F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))
    rows = table(spark, sf_dir, "book_score").select(
        guid("book_id").alias("book_id"), code("author_code").alias("author"), code("series_code").alias("series"), F.when(plain != "", plain).alias("split"))
    return rows, reliable(record_groups(rows, "book_id", {"author": "author", "series": "series"}))


def p4_found(spark, sf_dir: str) -> DataFrame:
    rows, groups = book_groups(spark, sf_dir)
    named = rows.where("book_id is not null and split is not null").select(F.col("book_id").alias("record"), "split").distinct()
    parted = (groups.join(named, "record").select("group", "split").distinct()
              .groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group"))
    return salted_join(groups, parted, ["group"], "left_semi").select(F.col("record").alias("book_id"))


def p4_splits(spark, sf_dir: str) -> DataFrame:
    _, groups = book_groups(spark, sf_dir)
    targets = [(r.split, r.share) for r in table(spark, sf_dir, "split_targets").collect()]  # one row a split, by its nature
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("weight"))
    return salted_join(groups, assign_splits(sizes, targets), ["group"]).select(F.col("record").alias("book_id"), F.col("group").alias("group_id"), F.col("weight").alias("group_books"), "split")


def p4_shares(spark, sf_dir: str) -> DataFrame:
    books = p4_splits(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_books"), F.countDistinct("group_id").alias("n_groups"))
    total = books.agg(F.sum("n_books")).first()[0] or 1
    targets = table(spark, sf_dir, "split_targets")
    return targets.join(books, "split", "left").select(
        "split", F.col("share").alias("target_share"), F.coalesce("n_books", F.lit(0)).alias("n_books"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
        (F.coalesce("n_books", F.lit(0)) / F.lit(total)).alias("actual_share"))
