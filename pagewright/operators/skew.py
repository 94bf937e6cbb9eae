"""Equi joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot from this share of the left rows on, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 1000
#: No key with fewer rows than this is worth spreading.
HOT_ROWS = 200_000


def hot_keys(df: DataFrame, keys: list[str], hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> list[tuple]:
    """(key..., salts) of the hot keys: at most ``1 / hot_share`` rows, counted with map-side combine.

    ``salts`` is such that no salted key has more than ``max(hot_rows, hot_share * rows)`` rows.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    top = counted.orderBy(F.desc("_n")).limit(int(1 / hot_share)).collect()
    if not top:
        return []
    room = max(hot_rows, int(df.count() * hot_share))
    return [(*[r[k] for k in keys], -(-r["_n"] // room)) for r in top if r["_n"] > room]


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", condition=None,
                spread: list[str] | None = None, rows: int | None = None, keys_from: DataFrame | None = None, hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join on ``keys`` (and ``condition(left, right)``), with hot left keys spread over several tasks.

    ``right``'s rows of a hot key are repeated once a salt; all others are shuffled once, so the plan
    is the ordinary shuffled join while no key is hot. ``how`` is any of inner, left, left_semi and
    left_anti. Rows with a null key match nothing. ``right`` must not have columns of ``left``
    other than ``keys``. The left side keeps its columns, the keys come once. A caller that knows the number of
    left rows passes it as ``rows``: too few rows for a hot key need no counting. Keys are counted on ``keys_from`` where given: a frame
    with at least the left side's rows of each key that is cheaper to read than ``left`` with all its steps.
    """
    hot = [] if rows is not None and rows <= hot_rows else hot_keys((left if keys_from is None else keys_from).where(" and ".join(f"`{k}` is not null" for k in keys)), keys, hot_share, hot_rows)
    on = list(keys)
    left, right = (df.drop("_salt", "_salts", *[f"_h{i}" for i in range(len(keys))]) for df in (left, right))
    if hot:
        fields = [left.schema[k] for k in keys]
        schema = T.StructType([T.StructField(f"_h{i}", f.dataType) for i, f in enumerate(fields)] + [T.StructField("_salts", T.LongType())])
        small = F.broadcast(left.sparkSession.createDataFrame(hot, schema))  # at most 1 / hot_share rows

        def with_salts(df: DataFrame) -> DataFrame:
            cond = [df[k] == small[f"_h{i}"] for i, k in enumerate(keys)]
            return df.join(small, cond, "left").drop(*[f"_h{i}" for i in range(len(keys))])

        salt = F.pmod(F.xxhash64(*[F.col(c) for c in (spread or left.columns)]), F.coalesce("_salts", F.lit(1)))
        left = with_salts(left).withColumn("_salt", salt.cast("long")).drop("_salts")
        right = with_salts(right).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
        on = [*on, "_salt"]
    if condition is None:
        out = left.join(right, on, how)
    else:
        a, b = left.alias("a"), right.alias("b")
        cond = condition(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))
        for k in on:
            cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        out = a.join(b, cond, how)
        cols = [F.col(f"a.{c}") for c in left.columns]
        if how not in ("left_semi", "left_anti"):
            cols += [F.col(f"b.{c}") for c in right.columns if c not in on]
        out = out.select(*cols)
    return out.drop("_salt")
