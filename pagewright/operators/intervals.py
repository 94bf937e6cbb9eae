"""Overlapping and gapped intervals: one global range sort and a prefix-combined scan.

Rows are range-partitioned by (entity, start, end), so an entity of any size is spread over many tasks.
A first pass leaves one summary a partition (its last entity, that entity's greatest end and the start of
its last island); the summaries, as many as there are partitions, are combined in order; a second pass
rescans each partition with the state carried into it and labels every row with its island.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.keys import guid
from pagewright.session import reliable, table

State = tuple[str, int, int, int] | None  # entity, greatest end so far, start of the open island, greatest end of an owned row
_NONE = -(1 << 62)


def _before(values: np.ndarray, seg: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value of each segment's earlier rows and up to each row; the first segment starts from ``carried``."""
    top = pd.Series(values).groupby(seg).cummax().to_numpy()
    top[seg == 1] = np.maximum(top[seg == 1], carried)
    prev = np.r_[carried, top[:-1]]
    prev[np.r_[False, seg[1:] != seg[:-1]]] = _NONE
    return prev, top


def scan(pdf: pd.DataFrame, state: State, join: int) -> tuple[pd.DataFrame, State]:
    """Previous greatest ends and island start of each row of a sorted batch, and the state after it."""
    if pdf.empty:
        none = pd.array([], dtype="Int64")
        return pdf.assign(prev_end=none, prev_owned=none, island_start=np.array([], dtype="int64")), state
    entity, start, end = pdf["_entity"].to_numpy(), pdf["_s"].to_numpy("int64"), pdf["_e"].to_numpy("int64")
    seg = np.cumsum(np.r_[True, entity[1:] != entity[:-1]])
    carried = state is not None and state[0] == entity[0]
    prev, top = _before(end, seg, state[1] if carried else _NONE)
    owned, top_owned = _before(np.where(pdf["_own"].to_numpy(bool), end, _NONE), seg, state[3] if carried else _NONE)
    at = np.maximum.accumulate(np.where((prev == _NONE) | (start > prev + join), np.arange(len(start)), -1))
    island = np.where(at >= 0, start[np.maximum(at, 0)], state[2] if carried else 0)

    def known(v: np.ndarray) -> pd.arrays.IntegerArray:
        return pd.arrays.IntegerArray(v, v == _NONE)

    return pdf.assign(prev_end=known(prev), prev_owned=known(owned), island_start=island), (entity[-1], int(top[-1]), int(island[-1]), int(top_owned[-1]))


def combine(before: State, first: str, last: str, top: int, opened: int, owned: int, join: int) -> State:
    """The state after a partition from the state before it and the partition's summary."""
    if before is None or first != last or before[0] != last:
        return (last, top, opened, owned)
    return (last, max(before[1], top), before[2] if opened <= before[1] + join else opened, max(before[3], owned))


def islands(df: DataFrame, entity: list[str], start: str, end: str, join: int = 1, owner: str | None = None) -> DataFrame:
    """``df`` with ``prev_end`` (greatest end of the entity's earlier rows), ``prev_owned`` (of those with an ``owner``) and ``island_start``.

    Intervals [start, end] are whole numbers, both ends included; two belong to one island when the
    later starts at most ``join`` after the greatest end so far. Rows with a null bound or an end before the
    start are dropped; a null in ``entity`` is an entity of its own; repeated rows count as one interval each. An empty table gives no
    row. Columns of ``df`` that are named like those added are replaced. The range sort has as many partitions as the data fill.
    """
    df = df.drop("_entity", "_s", "_e", "_own", "prev_end", "prev_owned", "island_start")
    own = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(entity)]))
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    rows = rows.withColumns({"_entity": own, "_s": F.col(start).cast("long"), "_e": F.col(end).cast("long"), "_own": F.col(owner).isNotNull() if owner else F.lit(True)})
    rows = reliable(rows.repartitionByRange("_entity", "_s", "_e").sortWithinPartitions("_entity", "_s", "_e"))

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, first = None, None
        for pdf in batches:
            if len(pdf):
                first = first if first is not None else pdf["_entity"].iloc[0]
                state = scan(pdf, state, join)[1]
        if state:
            yield pd.DataFrame([(TaskContext.get().partitionId(), first, *state)], columns=["pid", "first", "last", "top", "opened", "owned"])

    # one row a partition, whatever the data
    found = rows.select("_entity", "_s", "_e", "_own").mapInPandas(summaries, "pid int, first string, last string, top long, opened long, owned long").collect() if rows.rdd.getNumPartitions() > 1 else []
    carried: dict[int, State] = {}
    state: State = None
    for r in sorted(found, key=lambda r: r.pid):
        carried[r.pid] = state
        state = combine(state, r["first"], r["last"], r.top, r.opened, r.owned, join)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = carried.get(TaskContext.get().partitionId())
        for pdf in batches:
            out, state = scan(pdf, state, join)
            yield out

    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in ("prev_end", "prev_owned", "island_start")]])
    return rows.mapInPandas(label, schema).drop("_entity", "_s", "_e", "_own")


def periods(labelled: DataFrame, entity: list[str], end: str) -> DataFrame:
    """One row an island: its first and last unit."""
    return labelled.groupBy(*entity, "island_start").agg(F.max(end).cast("long").alias("last_page")).withColumnRenamed("island_start", "first_page")


def gaps(labelled: DataFrame, entity: list[str], start: str) -> DataFrame:
    """The uncovered runs between an entity's islands, from the rows that open an island."""
    opens = F.col("prev_end").isNotNull() & (F.col(start).cast("long") == F.col("island_start")) & (F.col(start) > F.col("prev_end") + 1)
    return labelled.where(opens).select(*entity, (F.col("prev_end") + 1).alias("first_page"), (F.col(start) - 1).cast("long").alias("last_page"))


def swept(df: DataFrame, entity: list[str], owner: str, start: str, end: str) -> DataFrame:
    """The entity's intervals (entity, owner, first_page, last_page) with their islands, each owner's merged first.

    One sweep serves periods, gaps and double claims: merging within an owner changes no union, and two merged intervals that
    share a unit have two owners.
    """
    merged = periods(islands(df.select(*entity, owner, start, end), [*entity, owner], start, end), [*entity, owner], end)
    return reliable(islands(merged, entity, "first_page", "last_page", owner=owner))


def claimed_twice(sweep: DataFrame, entity: list[str], owner: str) -> DataFrame:
    """Longest runs of a sweep that two or more owners cover; a null owner is none.

    Of the sorted intervals, [start, min(end, prev_owned)] are exactly the units of a later one that an earlier one covers.
    """
    twice = sweep.where(F.col(owner).isNotNull() & (F.col("first_page") <= F.col("prev_owned"))).select(*entity, F.col("first_page").alias("_f"), F.least("last_page", "prev_owned").alias("_l"))
    return periods(islands(twice, entity, "_f", "_l"), entity, "_l")


def current_units(units: DataFrame) -> DataFrame:
    """Of each id the row with the latest guncelleme_zamani; equal times are decided by the row's greatest values."""
    cols = ["kitapid", "uniteid", "baslangicsayfasi", "bitissayfasi"]
    named = units.where("id is not null").groupBy(guid("id").alias("_i")).agg(F.max(F.struct("guncelleme_zamani", *cols)).alias("r")).select("r.*")
    rows = named.unionByName(units.where("id is null").select("guncelleme_zamani", *cols))
    return rows.select(guid("kitapid").alias("kitapid"), guid("uniteid").alias("uniteid"), "baslangicsayfasi", "bitissayfasi").where("kitapid is not null")


def p3_found(spark, sf_dir: str) -> DataFrame:
    sweep = swept(current_units(table(spark, sf_dir, "kitapunite")), ["kitapid"], "uniteid", "baslangicsayfasi", "bitissayfasi")
    parts = (("period", periods(sweep, ["kitapid"], "last_page")), ("gap", gaps(sweep, ["kitapid"], "first_page")), ("overlap", claimed_twice(sweep, ["kitapid"], "uniteid")))
    out = None
    for kind, df in parts:
        df = df.select("kitapid", F.lit(kind).alias("kind"), F.col("first_page").cast("int").alias("first_page"), F.col("last_page").cast("int").alias("last_page"))
        out = df if out is None else out.unionByName(df)
    return out
