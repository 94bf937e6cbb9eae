"""Page layout by sheet: columns, panels, XY-cut. A group is one sheet, whose atoms are few."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as geo
from pagewright.operators.grouped import fields, grouped


def panels(drawings: DataFrame, prose: DataFrame, markers: DataFrame, sheets: DataFrame) -> DataFrame:
    """Drawings that frame text: at least 60 x 30 points, not too tall, at most one marker, two lines or more; outermost first.

    Range joins on the sheet; a panel enclosed (two points allowed) by a larger kept one goes.
    """
    keys, r = ["book_id", "page"], F.col("rect")
    big = drawings.join(sheets.select(*keys, "height"), keys).where((geo.width(r) >= 60) & (geo.height(r) >= 30) & (geo.height(r) <= 0.695 * F.col("height"))).select(*keys, "ord", "rect")
    lines = prose.select(*keys, F.col("bbox").alias("b"))
    held = big.join(lines, keys).where(geo.encloses(r, F.col("b"), 2.0)).groupBy(*keys, "ord").agg(F.countDistinct(F.round((F.col("b.y0") + F.col("b.y1")) / 2)).alias("rows")).where("rows >= 2")
    marks = big.join(markers.select(*keys, F.col("bbox").alias("m")), keys).where(geo.encloses(r, F.col("m"), -2.0)).groupBy(*keys, "ord").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ok = big.join(held.drop("rows"), [*keys, "ord"], "left_semi").join(marks.drop("n"), [*keys, "ord"], "left_anti")

    names = ok.columns

    def outermost(g: dict[str, np.ndarray]) -> dict[str, list]:
        b = np.array([[x["x0"], x["y0"], x["x1"], x["y1"]] for x in g["rect"]], float)
        order = np.lexsort((g["ord"], -((b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]))))
        kept: list[int] = []
        for i in order:
            if not any(b[i, 0] >= b[k, 0] - 2 and b[i, 1] >= b[k, 1] - 2 and b[i, 2] <= b[k, 2] + 2 and b[i, 3] <= b[k, 3] + 2 for k in kept):
                kept.append(int(i))
        return {c: g[c][kept].tolist() for c in names}

    return grouped(ok, keys, ["ord"], outermost, fields(ok))


def _cut(b: np.ndarray, idx: np.ndarray, least: float, depth: int, out: list[np.ndarray]) -> None:
    if len(idx) > 1 and depth < 40:
        best = None
        for axis, sign in ((1, -1), (0, 1)):
            lo, hi = b[idx, axis], b[idx, axis + 2]
            order = np.argsort(lo, kind="stable")
            reach = np.maximum.accumulate(hi[order])
            gap = lo[order][1:] - reach[:-1]
            k = int(gap.argmax()) if len(gap) else -1
            if k >= 0 and gap[k] >= least and (best is None or gap[k] > best[0]):
                best = (gap[k], idx[order[: k + 1]], idx[order[k + 1:]], sign)
        if best:
            first, second = (best[1], best[2]) if best[3] > 0 else (best[2], best[1])
            _cut(b, first, least, depth + 1, out)
            _cut(b, second, least, depth + 1, out)
            return
    out.append(idx)


def xy_cut(atoms: DataFrame, keys: list[str], least: float = 12.0) -> DataFrame:
    """``atoms`` (keys, ord, x0, y0, x1, y1) with ``leaf``: recursive cuts at the widest clear valley of at least ``least`` points, top and left first."""
    names = atoms.columns

    def mark(g: dict[str, np.ndarray]) -> dict[str, list]:
        out: list[np.ndarray] = []
        b = np.stack([g[c].astype(float) for c in ("x0", "y0", "x1", "y1")], axis=1)
        _cut(b, np.arange(len(b)), least, 0, out)
        leaf = np.empty(len(b), int)
        for n, idx in enumerate(out):
            leaf[idx] = n
        return {c: g[c].tolist() for c in names} | {"leaf": leaf.tolist()}

    return grouped(atoms, keys, ["ord"], mark, fields(atoms, "leaf int"))


def columns(lines: DataFrame, keys: list[str], fuse: float = 54.0) -> DataFrame:
    """(keys, column, left): left edges of lines in clusters of at most ``fuse`` points, those with a tenth of the lines or three."""
    from pagewright.operators.sequence import anchor_clusters

    marked = anchor_clusters(lines.select(*keys, "ord", "x0"), keys, "x0", "ord", fuse)
    total = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    c = marked.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("k"), F.min("x0").alias("left")).join(total, keys)
    return c.where((F.col("k") >= 3) | (F.col("k") >= 0.1 * F.col("n"))).select(*keys, F.col("cluster").alias("column"), "left")


def furniture(content: DataFrame, pages: DataFrame, fold: float = 3.0, least: int = 4, share: float = 0.03) -> DataFrame:
    """``content`` (book_id, page, rect, ...) that is furniture, with ``pages``, the sheets on which its box recurs.

    A box is the same if its edges, folded to ``fold`` points (halves to the even), and the sheet's hand are. It must stand on ``least``
    sheets and on ``share`` of the book's page_count, rounded down. Boxes are counted before they are joined back.
    """
    r = F.col("rect")
    keys = {"_odd": F.col("page") % 2} | {f"_{c}": F.bround(r[c] / fold).cast("long") for c in ("x0", "y0", "x1", "y1")}
    own = content.withColumns(keys)
    often = own.select("book_id", "page", *keys).distinct().groupBy("book_id", *keys).agg(F.count(F.lit(1)).alias("pages")).join(pages, "book_id", "left")
    often = often.where(F.col("pages") >= F.greatest(F.lit(least), F.floor(share * F.coalesce("page_count", F.lit(0))))).drop("page_count")
    return own.join(often, ["book_id", *keys]).drop(*keys)
