"""Rectangles of one sheet that must not get in each other's way: seams, separation, closing on blocks, snapping, clean-up, welding.

Rectangles are arrays x0, y0, x1, y1 (points, y upwards). All steps end: each has a fixed greatest number of passes.
"""

from __future__ import annotations

import numpy as np

# What a region may be and how far it may give way.
THIN, TALL, GAP, HAIRLINE = 6.0, 0.7, 3.0, 0.25
RETREAT_SHARE, RETREAT_COST, SNAP_SHARE, SNAP_RATIO, CUT = 0.75, 0.5, 0.35, 2.5, 0.05


def area(r: np.ndarray) -> float:
    return max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])])


def encloses(outer: np.ndarray, inner: np.ndarray, tol: float) -> bool:
    return bool(inner[0] >= outer[0] - tol and inner[1] >= outer[1] - tol and inner[2] <= outer[2] + tol and inner[3] <= outer[3] + tol)


def is_cut(r: np.ndarray, block: np.ndarray) -> bool:
    return area(block) > 0 and CUT < overlap(r, block) / area(block) < 1 - CUT


def seams(walls: np.ndarray, low: float, high: float, from_: float, to: float, axis: int) -> np.ndarray:
    """Places on ``axis`` (1: heights, 0: sides) in [low, high] where a cut touches no wall: the middles of the white between walls.

    Only walls that lie in [from_, to] of the other axis count; the ends of the span are seams too where no wall is there.
    """
    other = 1 - axis
    own = walls[(walls[:, other] < to) & (walls[:, other + 2] > from_) & (walls[:, axis] < high) & (walls[:, axis + 2] > low)] if len(walls) else walls
    if not len(own):
        return np.array([(low + high) / 2])
    own = own[np.argsort(own[:, axis], kind="stable")]
    reach = np.maximum.accumulate(own[:, axis + 2])
    free = np.nonzero(own[1:, axis] >= reach[:-1])[0]
    out = ((own[1:, axis] + reach[:-1]) / 2)[free].tolist()
    if own[0, axis] >= low:
        out.append((low + own[0, axis]) / 2)
    if reach[-1] <= high:
        out.append((high + reach[-1]) / 2)
    out = np.array(sorted(out))
    return out[(out >= low) & (out <= high)]


def separate(parts: list[dict], walls: np.ndarray, passes: int = 6) -> list[dict]:
    """Parts ({box, owner, column, ...}) pushed apart along the axis of least penetration, at the seam nearest the middle, three points between.

    Two pieces of one owner in one column meet without a gap. Parts that become slivers are dropped.
    """
    for _ in range(passes):
        moved = False
        for n, p in enumerate(parts):
            for q in parts[n + 1:]:
                a, b = p["box"], q["box"]
                dx, dy = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                if dx <= 0 or dy <= 0:
                    continue
                moved = True
                same = p.get("owner") == q.get("owner") and p.get("column") == q.get("column")
                axis = 1 if same or dy <= dx else 0
                low, high = max(a[axis], b[axis]), min(a[axis + 2], b[axis + 2])
                at = (low + high) / 2
                if not same:
                    found = seams(walls, low, high, max(a[1 - axis], b[1 - axis]), min(a[3 - axis], b[3 - axis]), axis)
                    at = float(found[np.abs(found - at).argmin()]) if len(found) else at
                after, before = (a, b) if a[axis] + a[axis + 2] >= b[axis] + b[axis + 2] else (b, a)
                half = 0.0 if same else GAP / 2
                after[axis], before[axis + 2] = max(after[axis], at + half), min(before[axis + 2], at - half)
        if not moved:
            break
    return [p for p in parts if p["box"][2] - p["box"][0] >= THIN and p["box"][3] - p["box"][1] >= THIN]


def _free(box: np.ndarray, own: dict, parts: list[dict]) -> bool:
    return not any(overlap(box, p["box"]) > 1.0 for p in parts if p is not own)


def _retreat(box: np.ndarray, block: np.ndarray) -> np.ndarray | None:
    """``box`` drawn back from a block by the edge that costs least, if at least half of it stays."""
    ways = [np.array([block[2], box[1], box[2], box[3]]), np.array([box[0], block[3], box[2], box[3]]), np.array([box[0], box[1], block[0], box[3]]), np.array([box[0], box[1], box[2], block[1]])]
    left = [(area(w), k) for k, w in enumerate(ways) if w[2] - w[0] >= THIN and w[3] - w[1] >= THIN]
    if not left or max(left)[0] < RETREAT_COST * area(box):
        return None
    return ways[max(left)[1]]


def close_blocks(parts: list[dict], blocks: np.ndarray, height: float, passes: int = 6) -> None:
    """Each cut block goes whole to the part with its greatest share if nobody else is touched, the block is not twice the part and the result not too tall;
    else a part that holds under three quarters of it draws back."""
    for _ in range(passes):
        moved = False
        for block in blocks:
            shares = [(overlap(p["box"], block), -n) for n, p in enumerate(parts) if is_cut(p["box"], block)]
            for share, n in sorted(shares, reverse=True):
                p = parts[-n]
                wide = union(p["box"], block)
                if (share, n) == max(shares) and _free(wide, p, parts) and area(block) <= 2 * area(p["box"]) and wide[3] - wide[1] <= (TALL - 0.005) * height:
                    p["box"], moved = wide, True
                elif share < RETREAT_SHARE * area(block) and (back := _retreat(p["box"], block)) is not None:
                    p["box"], moved = back, True
        if not moved:
            return


def snap_edges(parts: list[dict], blocks: np.ndarray, passes: int = 3) -> list[dict]:
    """Parts that cut a block grow over it from a share of .35 on (a block of at most 2.5 times the part), else draw back, else grow after all; then
    parts that a sibling encloses go."""
    for _ in range(passes):
        moved = False
        for p in parts:
            for block in blocks:
                if not is_cut(p["box"], block):
                    continue
                wide, back = union(p["box"], block), _retreat(p["box"], block)
                grows = overlap(p["box"], block) >= SNAP_SHARE * area(block) and area(block) <= SNAP_RATIO * area(p["box"]) and _free(wide, p, parts)
                new = wide if grows else back if back is not None else wide if _free(wide, p, parts) else None
                if new is not None:
                    p["box"], moved = new, True
        if not moved:
            break
    held = [p for p in parts if any(q is not p and q.get("owner") == p.get("owner") and encloses(q["box"], p["box"], 0.0) and area(q["box"]) > area(p["box"]) for q in parts)]
    return [p for p in parts if not any(p is h for h in held)]


def clean(parts: list[dict], walls: np.ndarray, height: float, passes: int = 10) -> list[dict]:
    """Slivers go, hairline overlaps are closed in the middle, others parted again, and too tall parts cut from below at a seam."""
    parts = [p for p in parts if p["box"][2] - p["box"][0] >= THIN and p["box"][3] - p["box"][1] >= THIN]
    for _ in range(passes):
        before = [p["box"].copy() for p in parts]
        for n, p in enumerate(parts):
            for q in parts[n + 1:]:
                a, b = p["box"], q["box"]
                for axis in (0, 1):
                    low, high = max(a[axis], b[axis]), min(a[axis + 2], b[axis + 2])
                    if overlap(a, b) > 0 and high - low <= HAIRLINE:
                        after, first = (a, b) if a[axis] >= b[axis] else (b, a)
                        after[axis] = first[axis + 2] = (low + high) / 2
        parts = separate(parts, walls, 1)
        if len(before) == len(parts) and all((x == p["box"]).all() for x, p in zip(before, parts, strict=True)):
            break
    cap = (TALL - 0.005) * height
    for p in parts:
        b = p["box"]
        if b[3] - b[1] > cap:
            found = seams(walls, b[3] - cap, b[3] - THIN, b[0], b[2], 1)
            b[1] = max(b[3] - cap, float(found.min()) if len(found) else b[3] - cap)
    return parts


def settled(parts: list[dict], walls: np.ndarray, blocks: np.ndarray, height: float) -> list[dict]:
    """The whole sequence: close, separate, close, snap, clean."""
    close_blocks(parts, blocks, height)
    parts = separate(parts, walls)
    close_blocks(parts, blocks, height)
    return clean(snap_edges(parts, blocks), walls, height)


def weld(box: np.ndarray, slack: float = 6.0, reach: float = 0.6, most: float = 30.0, gutters: np.ndarray | None = None) -> np.ndarray:
    """A number for each rectangle: those that touch across a gap of ``slack``, or of ``reach`` of the smaller one's own short side up to ``most``, are one.

    A gap with the middle of a gutter in it is none. Numbers count from 0 in order of each group's first member.
    """
    n = len(box)
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    side = np.minimum(box[:, 2] - box[:, 0], box[:, 3] - box[:, 1]) if n else np.zeros(0)
    mid = (gutters[:, :2] + gutters[:, 2:]) / 2 if gutters is not None and len(gutters) else np.zeros((0, 2))
    for i in range(n):
        for j in range(i + 1, n):
            far = max(slack, min(most, reach * min(side[i], side[j])))
            dx, dy = max(box[i, 0], box[j, 0]) - min(box[i, 2], box[j, 2]), max(box[i, 1], box[j, 1]) - min(box[i, 3], box[j, 3])
            if dx > far or dy > far:
                continue
            lo = np.array([min(box[i, 2], box[j, 2]) if dx > 0 else max(box[i, 0], box[j, 0]), min(box[i, 3], box[j, 3]) if dy > 0 else max(box[i, 1], box[j, 1])])
            hi = lo + np.abs([dx, dy])
            if (dx > 0 or dy > 0) and ((mid >= lo) & (mid <= hi)).all(axis=1).any():
                continue
            up[max(top(i), top(j))] = min(top(i), top(j))
    first: dict[int, int] = {}
    return np.array([first.setdefault(top(i), len(first)) for i in range(n)], int)


def figures(tiles: np.ndarray, content: np.ndarray, captions: np.ndarray) -> list[dict]:
    """Whole pictures of tiles: {box, caption} from the top; ``captions`` are boxes of lines that read as one.

    Tiles under 4 points go, the others are clipped to the content and welded. A picture has a side of 24 points, 600 square points and less than six tenths of the
    content; one nine tenths inside a larger goes. Its caption is the topmost line within 14 points below or 24 beside.
    """
    t = np.stack([np.maximum(tiles[:, 0], content[0]), np.maximum(tiles[:, 1], content[1]), np.minimum(tiles[:, 2], content[2]), np.minimum(tiles[:, 3], content[3])], axis=1) if len(tiles) else tiles
    t = t[(t[:, 2] - t[:, 0] >= 4) & (t[:, 3] - t[:, 1] >= 4)] if len(t) else t
    group = weld(t)
    whole = [np.array([*t[group == k, :2].min(axis=0), *t[group == k, 2:].max(axis=0)]) for k in range(group.max(initial=-1) + 1)]
    whole = [b for b in whole if max(b[2] - b[0], b[3] - b[1]) >= 24 and area(b) >= 600 and area(b) < 0.6 * area(content)]
    whole = [b for b in whole if not any(area(o) > area(b) and overlap(o, b) >= 0.9 * area(b) for o in whole)]
    out = []
    for b in sorted(whole, key=lambda b: (-b[3], b[0])):
        under = [k for k, c in enumerate(captions) if 0 <= b[1] - c[3] <= 14 and min(b[2], c[2]) > max(b[0], c[0])]
        beside = [k for k, c in enumerate(captions) if max(b[0], c[0]) - min(b[2], c[2]) <= 24 and min(b[3], c[3]) > max(b[1], c[1])]
        found = sorted({*under, *beside}, key=lambda k: (-captions[k][3], k))
        out.append({"box": b, "caption": found[0] if found else None})
    return out


def answer_spaces(rules: np.ndarray, prose: np.ndarray, thick: float = 3.75, least: float = 20.0) -> list[dict]:
    """Blanks to write in, from ruled lines: {kind: 'cell' or 'grid', box}.

    Rules (at most ``thick`` thin, ``least`` long) within 6 points sideways and 30 up belong together unless a line of prose stands between. A cluster of two
    rows and more makes cells between neighbouring heights and uprights; without two uprights it is as wide as the cluster and gets one more row above, at
    the median pitch. Cells under 8 points, or with the middle of a line of prose in them, are none. With three heights and two uprights the whole is a grid too.
    """
    w, h = rules[:, 2] - rules[:, 0], rules[:, 3] - rules[:, 1]
    flat, upright = (h <= thick) & (w >= least), (w <= thick) & (h >= least)
    own = rules[flat | upright]
    is_flat = flat[flat | upright]
    up = list(range(len(own)))

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(own)):
        for j in range(i + 1, len(own)):
            dx, dy = max(own[i, 0], own[j, 0]) - min(own[i, 2], own[j, 2]), max(own[i, 1], own[j, 1]) - min(own[i, 3], own[j, 3])
            between = dy > 6 and any(min(own[i, 3], own[j, 3]) <= (p[1] + p[3]) / 2 <= max(own[i, 1], own[j, 1]) and p[0] < max(own[i, 2], own[j, 2]) and p[2] > min(own[i, 0], own[j, 0]) for p in prose)
            if dx <= 6 and dy <= 30 and not between:
                up[max(top(i), top(j))] = min(top(i), top(j))
    out: list[dict] = []
    for k in sorted({top(i) for i in range(len(own))}):
        at = np.array([i for i in range(len(own)) if top(i) == k])
        ys = np.unique(np.round((own[at][is_flat[at], 1] + own[at][is_flat[at], 3]) / 2, 1))
        xs = np.unique(np.round((own[at][~is_flat[at], 0] + own[at][~is_flat[at], 2]) / 2, 1))
        if len(ys) < 2:
            continue
        ruled = len(xs) >= 2
        if not ruled:
            xs = np.array([own[at, 0].min(), own[at, 2].max()])
            pitch = np.sort(np.diff(ys))
            ys = np.r_[ys, ys[-1] + pitch[len(pitch) // 2]]
        elif len(ys) >= 3:
            out.append({"kind": "grid", "box": np.array([xs[0], ys[0], xs[-1], ys[-1]])})
        for y0, y1 in zip(ys, ys[1:], strict=False):
            for x0, x1 in zip(xs, xs[1:], strict=False):
                inside = any(x0 <= (p[0] + p[2]) / 2 <= x1 and y0 <= (p[1] + p[3]) / 2 <= y1 for p in prose)
                if x1 - x0 >= 8 and y1 - y0 >= 8 and not inside:
                    out.append({"kind": "cell", "box": np.array([x0, y0, x1, y1])})
    return out


def strips(heights: list[float], free: list[bool], least: float = 24.0) -> list[tuple[float, float]]:
    """Strips between falling ``heights``; while one that is ``free`` of markers is lower than ``least``, the lowest joins its taller neighbour."""
    out = [[a, b, f] for a, b, f in zip(heights, heights[1:], free, strict=False)]
    while len(out) > 1 and (low := [i for i, s in enumerate(out) if s[2] and s[0] - s[1] < least]):
        i = min(low, key=lambda i: (out[i][0] - out[i][1], i))
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(out)]
        j = max(near, key=lambda j: (out[j][0] - out[j][1], -j))
        a, b = sorted((i, j))
        out[a:b + 1] = [[out[a][0], out[b][1], out[a][2] and out[b][2]]]
    return [(a, b) for a, b, _ in out]


def blocked_runs(blocks: np.ndarray, at: float, top: float, bottom: float, bridge: float = 12.0) -> list[tuple[float, float]]:
    """(from, to) heights, from the top, where a block stands across the line x = ``at``; runs with at most ``bridge`` of white between are one."""
    own = sorted(((min(b[3], top), max(b[1], bottom)) for b in blocks if b[0] < at < b[2] and b[1] < top and b[3] > bottom), reverse=True)
    out: list[list[float]] = []
    for hi, lo in own:
        if out and out[-1][1] - hi <= bridge:
            out[-1][1] = min(out[-1][1], lo)
        else:
            out.append([hi, lo])
    return [(a, b) for a, b in out]


def coalesced(strip: list[tuple[float, float, object]]) -> list[tuple[float, float, object]]:
    """Neighbouring strips (from, to, value) of equal value as one."""
    out: list[list] = []
    for hi, lo, v in strip:
        if out and out[-1][2] == v and out[-1][1] == hi:
            out[-1][1] = lo
        else:
            out.append([hi, lo, v])
    return [tuple(s) for s in out]
