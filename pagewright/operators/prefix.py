"""Running sums over a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.session import reliable


def running_sum(df: DataFrame, order: list[str], weight: str, name: str = "running", more: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` (null as 0) over all rows up to and with this one in ``order``; ``more`` names further pairs.

    The rows are range-partitioned (small data in few partitions) and sorted; only one row of sums a partition goes to the driver.
    ``order`` must be unique for a defined result. An empty table stays empty; columns of ``df`` named like those added are replaced.
    """
    sums = {weight: name} | (more or {})
    df = df.drop(*[n for n in sums.values() if n not in order and n not in sums])
    rows = reliable(df.withColumns({f"_w_{n}": F.coalesce(F.col(w).cast("double"), F.lit(0.0)) for w, n in sums.items()}).repartitionByRange(*order).sortWithinPartitions(*order))
    found = rows.groupBy(F.spark_partition_id().alias("pid")).agg(*[F.sum(f"_w_{n}").alias(n) for n in sums.values()]).orderBy("pid").collect()
    before, at = {}, dict.fromkeys(sums.values(), 0.0)
    for r in found:
        before[r.pid] = at
        at = {n: at[n] + r[n] for n in at}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = dict(before.get(TaskContext.get().partitionId(), {}))
        for pdf in batches:
            for n in sums.values():
                run = total.get(n, 0.0) + pdf[f"_w_{n}"].cumsum()
                total[n] = float(run.iloc[-1]) if len(run) else total.get(n, 0.0)
                pdf[n] = run
            yield pdf

    return rows.mapInPandas(add, T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in sums.values()]])).drop(*[f"_w_{n}" for n in sums.values()])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``df`` with ``name``: the row's number from 1 within ``keys`` by ``order``, where one key may hold any part of the rows."""
    df = df.drop("_upto", "_start", *[c for c in [name] if c not in keys and c not in order])
    run = running_sum(df.withColumn("_one", F.lit(1)), [*keys, *order], "_one", "_upto").drop("_one")
    if not keys:
        return run.withColumn(name, F.col("_upto").cast("long")).drop("_upto")
    start = run.groupBy(*keys).agg((F.min("_upto") - 1).alias("_start"))
    return run.join(start, keys).withColumn(name, (F.col("_upto") - F.col("_start")).cast("long")).drop("_upto", "_start")
