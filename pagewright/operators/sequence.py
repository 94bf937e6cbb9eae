"""Ordered sequences: anchor clusters, islands, label runs, numbering, folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.operators.grouped import fields, grouped, repeated


def anchor_clusters(rows: DataFrame, keys: list[str], value: str, ordinal: str, tol: float) -> DataFrame:
    """``rows`` with ``cluster`` (from 1): values in order open a new one when over ``tol`` from the cluster's first value.

    Not the same as gaps between neighbours, as a slow drift ends a cluster. The state is one number a group; a group is
    one sheet's or one book's. Null values come first and share cluster 0.
    """
    names = rows.columns

    def mark(g: dict[str, np.ndarray]) -> dict[str, list]:
        out, first, n = [], None, 0
        for v in g[value].astype(float).tolist():
            if v != v:
                out.append(0)
                continue
            if first is None or v - first > tol:
                first, n = v, n + 1
            out.append(n)
        return {c: g[c].tolist() for c in names} | {"cluster": out}

    return grouped(rows, keys, [F.asc_nulls_first(value), ordinal], mark, fields(rows, "cluster int"))


def text_lines(spans: DataFrame) -> DataFrame:
    """Spans grouped to lines: tops within 2.5 points of the line's first span, from the top down; then one row a line."""
    s = spans.select("book_id", "page", "span_id", "text", "bbox", (-F.col("bbox.y1")).alias("down"), F.col("bbox.x0").alias("x"))
    marked = anchor_clusters(s, ["book_id", "page"], "down", "span_id", 2.5)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("x", "span_id", "text"))), lambda p: p["text"])  # one line's spans
    return marked.groupBy("book_id", "page", F.col("cluster").alias("line")).agg(
        F.count(F.lit(1)).alias("n_spans"), F.array_join(parts, " ").alias("text"), F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))


def sessions(rows: DataFrame, keys: list[str], order: list, opens: Column, name: str = "session") -> DataFrame:
    """``rows`` with a number that grows by one at every row that ``opens`` (which may look back by lag over the same window)."""
    return rows.withColumn(name, F.sum(F.coalesce(opens.cast("int"), F.lit(1))).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def valleys(rows: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Clear gaps between projections: (keys, from, to) where the next starts beyond everything before it."""
    w = W.partitionBy(*keys).orderBy(low, high).rowsBetween(W.unboundedPreceding, -1)
    r = rows.withColumn("_reach", F.max(high).over(w))
    return r.where(F.col(low) > F.col("_reach")).select(*keys, F.col("_reach").alias("gap_from"), F.col(low).alias("gap_to"))


def longest_run(rows: DataFrame, keys: list[str], order: str, value: str, gap: float = 0.01) -> DataFrame:
    """(keys, n, score) of the best rising run per group: a row adds 1, each skipped value costs ``gap``.

    Of equal scores the run that ends first wins. The programme is quadratic in a group, which is one column of a sheet.
    """
    def best(g: dict[str, np.ndarray]) -> dict[str, list]:
        v = g[value].astype(float)
        v = v[~np.isnan(v)]
        if not len(v):
            return repeated(g, keys) | {"n": [0], "score": [0.0]}
        score, size = np.ones(len(v)), np.ones(len(v), int)
        for i in range(1, len(v)):
            step = v[i] - v[:i]
            gain = np.where(step > 0, score[:i] + 1 - gap * np.maximum(step - 1, 0), -np.inf)
            j = int(gain.argmax())
            if gain[j] > score[i]:
                score[i], size[i] = gain[j], size[j] + 1
        k = int(score.argmax())
        return repeated(g, keys) | {"n": [int(size[k])], "score": [float(score[k])]}

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return grouped(rows, keys, [order], best, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long", "score double"]))


def longest_label_run(rows: DataFrame, keys: list[str], order: str, kind: str, value: str, gap: float = 0.01) -> DataFrame:
    """(keys, n, score, n_kept): the programme of ``longest_run`` in each kind, where a label of value 1 may restart after any other.

    ``n`` and ``score`` are the better kind's (of equal scores, the first kind by name), ``n_kept`` the labels of all kinds' runs. Letters
    whose score stays under 2 are no run unless it ends at value 1. A group is one column of a sheet.
    """
    def run(name: str, v: list[float]) -> tuple[float, int]:
        score, size = [1.0] * len(v), [1] * len(v)
        for i, x in enumerate(v):
            for j in range(i):
                if v[j] < x or x == 1.0:
                    s = score[j] + 1 - (gap * max(x - v[j] - 1, 0.0) if v[j] < x else 0.0)
                    if s > score[i]:
                        score[i], size[i] = s, size[j] + 1
        k = max(range(len(v)), key=score.__getitem__)
        return (0.0, 0) if score[k] < 2 and name == "letter" and v[k] != 1.0 else (score[k], size[k])

    def best(g: dict[str, np.ndarray]) -> dict[str, list]:
        runs: dict[str, list[float]] = {}
        for name, v in zip(g[kind].tolist(), g[value].tolist(), strict=True):
            if name is not None:
                runs.setdefault(name, []).append(v)
        found = [run(name, v) for name, v in sorted(runs.items())] or [(0.0, 0)]
        score, n = max(found, key=lambda x: x[0])
        return repeated(g, keys) | {"n": [n], "score": [score], "n_kept": [sum(x[1] for x in found)]}

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return grouped(rows, keys, [order], best, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long", "score double", "n_kept long"]))


def counts_from_one(values: Column) -> Column:
    """Whether the distinct values of an array are 1..n; an empty array is none."""
    s = F.array_sort(F.array_distinct(F.array_compact(values)))
    return (F.size(s) > 0) & (s == F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))).cast("array<bigint>"))


def toc_parents(rows: DataFrame, book: str, order: str, level: str) -> DataFrame:
    """``rows`` with ``parent``: the latest row before of a smaller level, at any depth; null at the top. The state is the stack of open levels."""
    names = rows.columns

    def step(g: dict[str, np.ndarray]) -> dict[str, list]:
        stack, out = [], []
        for at, depth in zip(g[order].tolist(), g[level].tolist(), strict=True):
            while stack and stack[-1][0] >= depth:
                stack.pop()
            out.append(stack[-1][1] if stack else None)
            stack.append((depth, at))
        return {c: g[c].tolist() for c in names} | {"parent": out}

    return grouped(rows, [book], [order], step, fields(rows, "parent long"))


def budget_skip(rows: DataFrame, keys: list[str], order: list, size: str, budget: int, count: int | None = None) -> DataFrame:
    """Rows kept in ``order`` while they fit ``budget`` (and ``count``): what does not fit is skipped, later smaller ones may still fit.

    One running sum a group is all that is held, so a group of any size passes in batches.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used, n = None, 0, 0
        for pdf in batches:
            kept = []
            for at, x in zip(zip(*(pdf[k] for k in keys), strict=True), pdf[size], strict=True):
                if at != group:
                    group, used, n = at, 0, 0
                fits = used + x <= budget and (count is None or n < count)
                if fits:
                    used, n = used + x, n + 1
                kept.append(fits)
            yield pdf[kept]

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, rows.schema)


