"""Strokes of ink: simplification, erasing, boxes, and their event-sourced store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far points (n x 2) lie from the segment a-b."""
    d = b - a
    n = float(d @ d)
    t = np.clip((p - a) @ d / n, 0, 1) if n else np.zeros(len(p))
    return np.hypot(*(p - (a + t[:, None] * d)).T)


def crosses(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> bool:
    """Whether segments a-b and c-d share a point, ends and collinear touches included."""
    def turn(p, q, r):
        return np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    def on(p, q, r):
        return min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])

    w, x, y, z = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    return bool((w != x and y != z) or (w == 0 and on(a, b, c)) or (x == 0 and on(a, b, d)) or (y == 0 and on(c, d, a)) or (z == 0 and on(c, d, b)))


def segment_distance(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> float:
    if crosses(a, b, c, d):
        return 0.0
    return float(min(distance(np.array([a, b]), c, d).min(), distance(np.array([c, d]), a, b).min()))


def simplify(points: np.ndarray, tol: float) -> np.ndarray:
    """The points that stand over ``tol`` from the line between the kept ones beside them; the first and last stay. Without recursion."""
    keep, todo = np.zeros(len(points), bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        far = distance(points[a + 1:b], points[a], points[b])
        k = int(far.argmax())
        if far[k] > tol:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def erase(points: np.ndarray, a: np.ndarray, b: np.ndarray, radius: float) -> list[np.ndarray]:
    """What is left of a stroke after an eraser of ``radius`` went from a to b: runs of at least two points."""
    if not len(points):
        return []
    gone = distance(points, a, b) <= radius
    cut = np.array([gone[i] or gone[i + 1] or segment_distance(points[i], points[i + 1], a, b) <= radius for i in range(len(points) - 1)], bool)
    runs, start = [], 0
    for i in range(len(points)):
        if i == len(points) - 1 or cut[i]:
            runs.append(points[start:i + 1][~gone[start:i + 1]])
            start = i + 1
    return [r for r in runs if len(r) > 1]


def _pairs(flat: list[float]) -> np.ndarray:
    """Points of a flat list of coordinates; a list of odd length loses its last."""
    return np.array(flat[: len(flat) // 2 * 2], float).reshape(-1, 2)


def simplified(points: Column, tol: float) -> Column:
    """A flat array of coordinates, simplified, one decimal; null stays null."""
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.round(simplify(_pairs(list(x)), tol), 1).ravel().tolist() if len(x) > 3 else list(x), na_action="ignore")

    return run(points)


def erased(strokes: DataFrame, a: tuple[float, float], b: tuple[float, float], radius: float) -> DataFrame:
    """``strokes`` (id, points, ...) after one move of an eraser: untouched ones as they are, others as runs with ``run`` from 0; wholly erased ones go.

    Boxes that the eraser cannot reach are passed over before any point is looked at.
    """
    p, q = np.array(a, float), np.array(b, float)
    lo, hi = np.minimum(p, q) - radius, np.maximum(p, q) + radius

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                pts = _pairs(list(r["points"])) if r["points"] is not None else np.zeros((0, 2))
                near = len(pts) and (pts.min(axis=0) <= hi).all() and (pts.max(axis=0) >= lo).all()
                left = erase(pts, p, q, radius) if near else [pts]
                whole = len(left) == 1 and len(left[0]) == len(pts)
                rows += [r | {"run": 0}] if whole else [r | {"points": x.ravel().tolist(), "run": k} for k, x in enumerate(left)]
            if rows:
                yield pd.DataFrame(rows)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in strokes.schema.fields) + ", run int"
    return strokes.mapInPandas(run, fields)


def outline(points: Column, width: Column) -> Column:
    """The box around a stroke and its width, as (x0, y0, x1, y1); null without points."""
    xs = F.filter(points, lambda _, i: i % 2 == 0)
    ys = F.filter(points, lambda _, i: i % 2 == 1)
    w = width / 2
    return F.when(F.size(ys) > 0, F.struct((F.array_min(xs) - w).alias("x0"), (F.array_min(ys) - w).alias("y0"), (F.array_max(xs) + w).alias("x1"), (F.array_max(ys) + w).alias("y1")))


def valid(strokes: DataFrame) -> DataFrame:
    """Strokes with a page, an id and at least two whole points; each bad record goes alone."""
    return strokes.where(F.col("id").isNotNull() & (F.col("page") >= 1) & (F.size("points") >= 4) & (F.size("points") % 2 == 0) & ~F.exists("points", lambda x: x.isNull() | F.isnan(x)))


def store(events: DataFrame) -> DataFrame:
    """Strokes that are there after events (seq, op, page, id, ...): add and restore put one, remove takes it, clear takes all of its page before it.

    One aggregation for clears and one for the rest: the last event of an id decides.
    """
    cleared = events.where("op = 'clear'").groupBy("page").agg(F.max("seq").alias("_clear"))
    own = events.where("op <> 'clear' and id is not null")
    row = F.struct(*[c for c in own.columns if c != "id"])
    last = own.groupBy("id").agg(F.max_by(row, "seq").alias("r"), F.max_by(row, F.when(F.col("op") == "add", F.col("seq"))).alias("a"))
    # a restored stroke comes back as it was added
    j = last.select("id", F.col("r.op").alias("_op"), F.col("r.seq").alias("_seq"), F.col("a.page").alias("page"), *[F.col(f"a.{c}").alias(c) for c in own.columns if c not in ("id", "op", "seq", "page")])
    return j.join(cleared, "page", "left").where("_op in ('add', 'restore') and (_clear is null or _seq > _clear)").drop("_op", "_seq", "_clear")


def page_versions(events: DataFrame) -> DataFrame:
    """(page, version): how often a page's ink changed."""
    return events.groupBy("page").agg(F.count(F.lit(1)).alias("version"))


def net_changes(events: DataFrame, session: list[str]) -> DataFrame:
    """(session, id, net) of added (+1) and removed (-1) strokes of an erasing session; what cancels out is gone, so undo replays the rest."""
    sign = F.when(F.col("op").isin("add", "restore"), 1).when(F.col("op") == "remove", -1).otherwise(0)
    return events.groupBy(*session, "id").agg(F.sum(sign).alias("net")).where("net <> 0")


def within_budget(strokes: DataFrame, keys: list[str], size: str, budget: int, protected: DataFrame | None = None) -> DataFrame:
    """Strokes that stay when the oldest go until the rest fits; ``protected`` ids stay and are counted first."""
    own = strokes.withColumn("_p", F.lit(False)) if protected is None else strokes.join(protected.select("id").distinct().withColumn("_x", F.lit(True)), "id", "left").withColumn("_p", F.coalesce("_x", F.lit(False))).drop("_x")
    held = F.sum(size).over(W.partitionBy(*keys).orderBy(F.desc("_p"), F.desc("created_ms"), "id").rowsBetween(W.unboundedPreceding, 0))
    return own.withColumn("_held", held).where(F.col("_p") | (F.col("_held") <= budget)).drop("_held", "_p")
