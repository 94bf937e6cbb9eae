"""What a sheet holds beside its activities, and boxes that come from elsewhere: content regions, icon-grown and detected regions, boxed gaps."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from pagewright.operators import pages as pg
from pagewright.operators import parts as pt
from pagewright.operators.grouped import repeated
from pagewright.operators.layout import _cut

#: Padding of a block of type, least letters worth a region, share of a line that makes it held, greatest sliver between two leaves.
PAD, LETTERS, HELD, LEAST_GAP = 3.0, 12, 0.5, 9.0
ABOVE, COLUMN_BLOCK, BREAK = 24.0, 120.0, 24.0


def held_lines(lines: np.ndarray, box: np.ndarray, share: float = HELD) -> np.ndarray:
    """Which lines lie in a box by at least ``share`` of their area."""
    both = np.clip(np.minimum(lines[:, 2], box[2]) - np.maximum(lines[:, 0], box[0]), 0, None) * np.clip(np.minimum(lines[:, 3], box[3]) - np.maximum(lines[:, 1], box[1]), 0, None)
    area = (lines[:, 2] - lines[:, 0]) * (lines[:, 3] - lines[:, 1])
    return both >= share * np.where(area > 0, area, np.inf)


def is_heading(size: float, bold: bool, text: str, body: float) -> bool:
    """A line set larger than the body, or bold and short."""
    return size >= pg.HEADING * body or (bold and len(text) <= 60)


def content_regions(s: pg.Sheet, activities: np.ndarray, lay: dict | None = None) -> list[dict]:
    """Regions of what no activity holds, in reading order: {box, headline}.

    Lines outside the activities are cut recursively at their clear valleys (nine points or 0.9 of a line), and parted again where the box of a leaf would run
    over an activity. A leaf is worth a region with twelve letters that are not just a heading; boxes are padded where that meets nothing, and
    end at seven tenths of the sheet.
    """
    lay = lay or pg.read_layout(s)
    rows = [(g, pg.around(s, g)) for g in pg.lines(s, lay["idx"])]
    if not rows:
        return []
    boxes = np.array([b for _, b in rows])
    taken = np.zeros(len(rows), bool)
    for a in activities:
        taken |= held_lines(boxes, a)
    free = np.nonzero(~taken)[0]
    if not len(free):
        return []
    leaves: list[np.ndarray] = []
    height = float(np.median(boxes[free, 3] - boxes[free, 1]))
    _cut(boxes, free, max(LEAST_GAP, 0.9 * height), 0, leaves)
    out: list[dict] = []
    for leaf in leaves:
        for part in apart(boxes, leaf, activities):
            text = [pg.text_of(s, rows[i][0]) for i in part]
            bare = all(is_heading(float(s.size[rows[i][0]].max()), bool(s.bold[rows[i][0]].all()), t, lay["size"]) for i, t in zip(part, text, strict=True))
            if sum(len(re.findall(r"\w", t)) for t in text) < LETTERS or bare:
                continue
            box = np.array([boxes[part, 0].min(), boxes[part, 1].min(), boxes[part, 2].max(), boxes[part, 3].max()])
            out.append({"box": box, "headline": clip(" ".join(text)), "owner": len(out), "column": 0})
    solid = [*activities, *[r["box"] for r in out]]
    for r in out:
        wide = r["box"] + np.array([-PAD, -PAD, PAD, PAD])
        if not any(pt.overlap(wide, o) > 0 for o in solid if o is not r["box"]):
            r["box"] = wide
    return pt.clean(out, boxes, s.height)


def apart(boxes: np.ndarray, leaf: np.ndarray, activities: np.ndarray) -> list[np.ndarray]:
    """A leaf's lines grouped by the side of each activity they are on, so that no group's box runs over one; groups from the top."""
    box = np.array([boxes[leaf, 0].min(), boxes[leaf, 1].min(), boxes[leaf, 2].max(), boxes[leaf, 3].max()])
    over = [a for a in activities if pt.overlap(box, a) > 0]
    if not over:
        return [leaf]

    def side(b: np.ndarray) -> tuple:
        return tuple("above" if b[1] >= a[3] - 1 else "below" if b[3] <= a[1] + 1 else "left" if b[2] <= a[0] + 1 else "right" if b[0] >= a[2] - 1 else "in" for a in over)

    groups: dict[tuple, list[int]] = {}
    for i in leaf:
        groups.setdefault(side(boxes[i]), []).append(int(i))
    out = [np.array(g) for k, g in groups.items() if "in" not in k]
    return sorted(out, key=lambda g: -boxes[g, 3].max())


def clip(text: str, most: int = 140) -> str:
    """Text cut at ``most`` characters with an ellipsis."""
    return text if len(text) <= most else text[: most - 1].rstrip() + "…"


def anchored_region(s: pg.Sheet, x: float, y: float, panels: np.ndarray, figures: np.ndarray, lay: dict | None = None) -> np.ndarray | None:
    """The region that an icon at (x, y) opens: the panel it is hung at, else the figure, else a block of its column; null without text.

    The line it means is the one least below it plus a quarter of the distance aside, among those not over 24 points above. A block goes on while
    gaps stay under 24 points, up to 120 points.
    """
    lay = lay or pg.read_layout(s)
    for blocks, tol in ((panels, 30.0), (figures, 15.0)):
        near = [b for b in blocks if b[0] - tol <= x <= b[2] + tol and b[1] - tol <= y <= b[3] + tol and b[3] - b[1] <= (pt.TALL - 0.005) * s.height]
        if near:
            return min(near, key=pt.area)
    rows = [pg.around(s, g) for g in pg.lines(s, lay["idx"])]
    cost = [(max(y - b[3], 0.0) + 0.25 * max(b[0] - x, x - b[2], 0.0), n) for n, b in enumerate(rows) if b[1] <= y + ABOVE]
    if not cost:
        return None
    first = rows[min(cost)[1]]
    box = first.copy()
    for b in sorted((b for b in rows if b[3] <= first[1] + 1 and min(b[2], first[2]) > max(b[0], first[0])), key=lambda b: -b[3]):
        if box[1] - b[3] > BREAK or first[3] - b[1] > COLUMN_BLOCK:
            break
        box = pt.union(box, b)
    return box + np.array([-PAD, -PAD, PAD, PAD])


def settle_boxes(boxes: np.ndarray, scores: np.ndarray, lines: np.ndarray, blocks: np.ndarray, height: float) -> list[dict]:
    """Detected boxes as regions: nested ones (six tenths of the smaller) dropped, best first, too tall ones left out, parted at the lines' seams and closed on blocks."""
    kept: list[int] = []
    for i in np.argsort(-scores, kind="stable"):
        tall = boxes[i, 3] - boxes[i, 1] > (pt.TALL - 0.005) * height
        if not tall and not any(pt.overlap(boxes[i], boxes[k]) >= 0.6 * min(pt.area(boxes[i]), pt.area(boxes[k])) for k in kept):
            kept.append(int(i))
    parts = [{"box": boxes[i].astype(float).copy(), "owner": i, "column": 0} for i in kept]
    return pt.settled(parts, lines, blocks, height)


def marker_for(box: np.ndarray, markers: np.ndarray, taken: set[int]) -> int | None:
    """The free marker in the top left quarter of a box, the topmost, then the leftmost."""
    mx, my = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    own = [(-m[3], m[0], n) for n, m in enumerate(markers) if n not in taken and box[0] - 2 <= (m[0] + m[2]) / 2 <= mx and my <= (m[1] + m[3]) / 2 <= box[3] + 2]
    return min(own)[2] if own else None


def fill_holes(values: list[float | None], most: int = 2) -> list[float] | None:
    """The labels that stand between boxed siblings: ``values`` in order with None for unboxed ones; all or nothing, runs of at most ``most``.

    Whole numbers must fit exactly between their neighbours; without holes, or where one does not fit, there is nothing to fill.
    """
    out, i, holes = list(values), 0, 0
    while i < len(out):
        if out[i] is not None:
            i += 1
            continue
        j = i
        while j < len(out) and out[j] is None:
            j += 1
        if i == 0 or j == len(out) or j - i > most or out[j] - out[i - 1] != j - i + 1:
            return None
        for k in range(i, j):
            out[k] = out[k - 1] + 1
        holes += j - i
        i = j
    return out if holes else None


def sub_questions(values: list[tuple[str, float]], box: np.ndarray, align: float = 4.0) -> list[int]:
    """Indexes of labels within an activity's band that are its sub-questions: of the first kind that makes a list from one, aligned within four points or along rows."""
    for kind in dict.fromkeys(k for k, _ in values):
        at = [i for i, (k, _) in enumerate(values) if k == kind]
        if len(at) > 1 and pg.reads_as_list(box[at], [values[i] for i in at]) and (np.ptp(box[at, 0]) <= align or len({round(float(y)) for y in box[at, 1]}) < len(at)):
            return at
    return []


def page_content(spans: DataFrame, sheets: DataFrame, activities: DataFrame, alone: bool = False) -> DataFrame:
    """One row a content region of every sheet with text; ``activities`` (book_id, page, rect) are grouped to their sheet first."""
    from pyspark.sql import functions as F

    r = F.col("rect")
    taken = activities.groupBy("book_id", "page").agg(F.collect_list(F.array(r["x0"], r["y0"], r["x1"], r["y1"])).alias("taken"))  # one sheet's regions
    rows = pg._sheets(spans, sheets).join(taken, ["book_id", "page"], "left")
    keys = ["book_id", "page"]

    def step(g):
        s = pg._sheet(g)
        own = g["taken"][0]
        acts = np.array([list(a) for a in own], float) if own is not None and len(own) else np.zeros((0, 4))
        found = content_regions(s, acts, pg.read_layout(s, alone))
        return repeated(g, keys, len(found)) | {"number": list(range(1, len(found) + 1)), "headline": [f["headline"] for f in found]} | pg._boxes([f["box"] for f in found])

    from pagewright.operators.grouped import grouped

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return grouped(rows, keys, ["ord"], step, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "number long, headline string, x0 double, y0 double, x1 double, y1 double"]))
