"""Assignments: candidate joins with gates, greedy one-to-one claims, suppression, detection matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.operators.grouped import fields, grouped, repeated
from pagewright.session import release, written


def reach(x: Column, left: Column, right: Column) -> Column:
    """How far a point lies beside [left, right], 0 inside."""
    return F.greatest(left - x, x - right, F.lit(0.0))


def gated_pairs(entries: DataFrame, regions: DataFrame, keys: list[str], confidence: str | None = None) -> DataFrame:
    """Every entry and region of the same ``keys`` with ``reason`` (null where the pair is a candidate), drift, reach and cost.

    Entries have entry_ord, e_label, x, y (percent, null where unknown); regions region_ord, r_label, left, top,
    right, bottom (percent) and bound. Gates in order: no-position, confidence-gated, label-mismatch, wrong-side, drift.
    Equality passes every limit. ``keys`` are those of one sheet, which bounds a group.
    """
    p = entries.join(regions, keys)
    el, rl = F.nullif("e_label", F.lit("")), F.nullif("r_label", F.lit(""))
    both = el.isNotNull() & rl.isNotNull()
    drift, side = F.abs(F.col("y") - F.col("top")), reach(F.col("x"), F.col("left"), F.col("right"))
    inside = (side == 0) & F.col("y").between(F.col("top"), F.col("bottom"))
    gated = F.lit(False)
    if confidence == "none":
        gated = ~F.col("bound")
    elif confidence == "weak":
        gated = ~F.col("bound") & el.isNull()
    reason = (F.when(F.col("y").isNull(), "no-position").when(gated, "confidence-gated").when(both & (el != rl), "label-mismatch")
              .when((side > 20) & ~both, "wrong-side").when((drift > F.when(both, 10).otherwise(5)) & ~inside, "drift"))
    return p.withColumns({"drift": drift, "reach": side, "reason": reason, "cost": drift + 0.5 * side})


# Why an entry did not link; of several reasons the first here counts.
REASONS = ("no-position", "confidence-gated", "label-mismatch", "drift", "wrong-side")


def explained(pairs: DataFrame, keys: list[str], entry: str = "entry_ord") -> DataFrame:
    """(keys, entry, candidates, reasons, gate) of gated pairs: how many candidates an entry has, all reasons met, and the one that counts.

    ``gate`` is contested where there is a candidate, else the first of REASONS; keys without regions give no row.
    """
    rank = F.array_position(F.lit(list(REASONS)), F.col("reason"))
    out = pairs.groupBy(*keys, entry).agg(F.count_if(F.col("reason").isNull()).alias("candidates"), F.sort_array(F.collect_set("reason")).alias("reasons"), F.min_by("reason", rank).alias("_first"))
    return out.select(*keys, entry, "candidates", "reasons", F.when(F.col("candidates") > 0, "contested").otherwise(F.col("_first")).alias("gate"))


def greedy_by_rounds(pairs: DataFrame, keys: list[str], left: str, right: str, order: list) -> DataFrame:
    """Greedy one-to-one claims in ``order``, natively: each round keeps the pairs that come first on both their sides.

    Equal to the sequential greedy as the order is total; each round is two windows over small groups and two anti-joins.
    """
    rest, taken = written(pairs), None
    lw, rw = W.partitionBy(*keys, left).orderBy(*order), W.partitionBy(*keys, right).orderBy(*order)
    while not rest.isEmpty():
        best = written(rest.withColumn("_l", F.row_number().over(lw)).withColumn("_r", F.row_number().over(rw)).where("_l = 1 and _r = 1").drop("_l", "_r"))
        taken = best if taken is None else taken.unionByName(best)
        before, rest = rest, written(rest.join(best.select(*keys, left), [*keys, left], "left_anti").join(best.select(*keys, right), [*keys, right], "left_anti"))
        release(before)
    return taken if taken is not None else pairs.limit(0)


def greedy_by_sheet(pairs: DataFrame, keys: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """The same claims in one pass over partitions sorted by sheet and ``order``; the state is one sheet's claimed sides."""
    def claim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sheet, used_l, used_r = None, set(), set()
        for pdf in batches:
            kept = []
            for at, a, b in zip(zip(*(pdf[k] for k in keys), strict=True), pdf[left], pdf[right], strict=True):
                if at != sheet:
                    sheet, used_l, used_r = at, set(), set()
                free = a not in used_l and b not in used_r
                if free:
                    used_l.add(a)
                    used_r.add(b)
                kept.append(free)
            yield pdf[kept]

    return pairs.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(claim, pairs.schema)


def override_claims(links: DataFrame, forced: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """``links`` with ``forced`` ones put through: any link of a forced entry or region goes; of two forced links of an entry the later region stays."""
    cols = [*keys, left, right]
    forced = forced.withColumn("_n", F.row_number().over(W.partitionBy(*keys, left).orderBy(F.desc(right)))).where("_n = 1").select(cols)
    kept = links.select(cols).join(forced.select(*keys, left), [*keys, left], "left_anti").join(forced.select(*keys, right), [*keys, right], "left_anti")
    return kept.unionByName(forced)


def _ious(boxes: np.ndarray, box: np.ndarray) -> np.ndarray:
    w = np.minimum(boxes[:, 2], box[2]) - np.maximum(boxes[:, 0], box[0])
    h = np.minimum(boxes[:, 3], box[3]) - np.maximum(boxes[:, 1], box[1])
    both = np.clip(w, 0, None) * np.clip(h, 0, None)
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    whole = area + (box[2] - box[0]) * (box[3] - box[1]) - both
    return np.where(whole > 0, both / np.where(whole > 0, whole, 1), 0.0)


def suppress(boxes: DataFrame, keys: list[str], score: str, ordinal: str, threshold: float = 0.5, nested: bool = False) -> DataFrame:
    """Non-maximum suppression of columns x0..y1 per ``keys``: by score, then ordinal, drop what overlaps a kept box.

    The measure is IoU, or with ``nested`` the shared part of the smaller box. The boxes of one page are few; the
    kept ones are compared at once.
    """
    names = boxes.columns

    def keep(g: dict[str, np.ndarray]) -> dict[str, list]:
        b = np.stack([g[c].astype(float) for c in ("x0", "y0", "x1", "y1")], axis=1)
        kept: list[int] = []
        for i in range(len(b)):
            if kept:
                k = b[kept]
                if nested:
                    w = np.minimum(k[:, 2], b[i, 2]) - np.maximum(k[:, 0], b[i, 0])
                    h = np.minimum(k[:, 3], b[i, 3]) - np.maximum(k[:, 1], b[i, 1])
                    size = (k[:, 2] - k[:, 0]) * (k[:, 3] - k[:, 1])
                    least = np.minimum(size, (b[i, 2] - b[i, 0]) * (b[i, 3] - b[i, 1]))
                    hit = np.clip(w, 0, None) * np.clip(h, 0, None) >= threshold * np.where(least > 0, least, np.inf)
                else:
                    hit = _ious(k, b[i]) >= threshold
                if hit.any():
                    continue
            kept.append(i)
        return {c: g[c][kept].tolist() for c in names}

    return grouped(boxes, keys, [F.desc(score), ordinal], keep, fields(boxes))


def match_detections(pred: DataFrame, truth: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (0.5,)) -> DataFrame:
    """``pred`` (keys, ord, score, x0..y1) with ``hits``, a flag for each threshold: by score, each takes the free truth of greatest IoU.

    Of equal overlaps the earlier truth is taken; a truth is matched once at each threshold. Both sides go to their page in one
    union, which is sorted truths first.
    """
    schema = fields(pred, "hits array<boolean>")
    cols, names = [*keys, "ord", "x0", "y0", "x1", "y1"], pred.columns
    both = pred.select(*pred.columns, F.lit(1).alias("_p")).unionByName(truth.select(*cols, F.lit(0).alias("_p")), allowMissingColumns=True)

    def match(g: dict[str, np.ndarray]) -> dict[str, list]:
        b, n = np.stack([g[c].astype(float) for c in ("x0", "y0", "x1", "y1")], axis=1), int((g["_p"] == 0).sum())
        free, hits = np.ones((len(thresholds), n), dtype=bool), []
        for box in b[n:]:
            iou, own = _ious(b[:n], box), []
            for k, least in enumerate(thresholds):
                v = np.where(free[k], iou, -1.0)
                best = int(v.argmax()) if n else -1
                ok = n > 0 and bool(v[best] >= least) and bool(v[best] > 0)
                if ok:
                    free[k, best] = False
                own.append(ok)
            hits.append(own)
        return {c: g[c][n:].tolist() for c in names} | {"hits": hits}

    return grouped(both, keys, ["_p", F.desc("score"), "ord"], match, schema)


def mutual_matches(a: DataFrame, b: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """(keys, n_a, n_b, matches, agreement) of two sets of boxes (keys, ord, x0..y1): greedy, best pair first; of equal pairs the later.

    Agreement is the matched part of all boxes. Pages that only one side has count too; pages without boxes are in neither.
    """
    cols = [*keys, "ord", "x0", "y0", "x1", "y1"]
    both = a.select(*cols, F.lit(0).alias("_s")).unionByName(b.select(*cols, F.lit(1).alias("_s")))

    def match(g: dict[str, np.ndarray]) -> dict[str, list]:
        box, n = np.stack([g[c].astype(float) for c in ("x0", "y0", "x1", "y1")], axis=1), int((g["_s"] == 0).sum())
        pairs = sorted(((v, i, j) for i in range(n) for j, v in enumerate(_ious(box[n:], box[i])) if v >= threshold), reverse=True)
        used_a, used_b = set(), set()
        for _, i, j in pairs:
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
        return repeated(g, keys) | {"n_a": [n], "n_b": [len(box) - n], "matches": [len(used_a)], "agreement": [2.0 * len(used_a) / len(box)]}

    kinds = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    return grouped(both, keys, ["_s", "ord"], match, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n_a long", "n_b long", "matches long", "agreement double"]))
