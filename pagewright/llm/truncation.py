"""Texts cut off by field limits, found by a backward character n-gram model.

The model runs backwards from a position: of the last characters before it, it knows how often a line
ends there and how often the text goes on. A whole text ends where lines end; a cut one stops where the
corpus goes on. Contexts are told apart by what opens their line (a bullet, a number, nothing). They are the suffixes
that close at least a given share of all lines, so their number is bounded; they are counted at every position of
every document, and a text is judged by the longest known suffix of its last line, without the positions that a still
longer known suffix explains. The log-odds are thresholded per language, where cut and whole texts part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.skew import salted_join
from pagewright.session import reliable, spread, table, written

#: Longest context in characters.
DEPTH = 28
#: A context of the model closes at least this share of the line ends (and LEAST of them): at most DEPTH / SHARE contexts.
SHARE, LEAST = 4e-5, 3
#: Occurrences that the estimate of the next shorter context weighs.
PRIOR = 6.0
#: Texts that the threshold of all weighs beside a language's own.
COMMON = 200
#: Histogram of log-odds: outer ones count at its ends. From EVEN on a text ends as likely as not, so it is none that was cut.
LOW, HIGH, STEP, EVEN = -12.0, 4.0, 0.25, -1.0
_CHUNK = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STOPS = ".!?…"
_CLOSE = ".!?…”\"’)» "


def tail_of(text: str | None) -> tuple[str, str]:
    """What is left of a text's end without what a storing system appends, and the kind of mark removed.

    Kinds: '' (none), 'dots' (an ellipsis), 'mark' (a broken character or a hyphen after a letter).
    """
    s = (text or "").rstrip()
    kind = ""
    while True:
        if s.endswith("…") or s.endswith("..."):
            s, kind = s.rstrip("…."), "dots"  # a blank before it stays: no whole text goes on like that
        elif s.endswith("�") or (s.endswith("-") and s[-2:-1].isalpha()):
            s, kind = s[:-1].rstrip(), "mark"
        else:
            return (s if s.strip() else ""), kind


def codes(text: str) -> np.ndarray:
    """Code points with all digits alike; tabs and blanks are blanks."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    a[(a >= 48) & (a <= 57)] = 48
    a[(a == 9) | (a == 160)] = 32
    return a


def _powers() -> np.ndarray:
    out = np.empty(DEPTH + 1, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        for k in range(1, DEPTH + 1):
            out[k] = out[k - 1] * _BASE
    return out


_POWER = _powers()


def _mixed(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))


def line_class(line: str) -> int:
    """What opens a line: a list or number mark (digits alike), a word with a colon, or anything else (0)."""
    first = line.lstrip().split(" ", 1)[0][:16]
    if not first or first.isalpha():
        return 0
    if first[-1] == ":":
        return 1
    if any(x.isalpha() for x in first):
        return 0
    shape = "".join("0" if x.isdigit() else x for x in first)
    while "00" in shape:
        shape = shape.replace("00", "0")
    return 2 + sum(ord(x) * 31 ** i for i, x in enumerate(shape)) % 1_000_003


def line_ends(text: str) -> Iterator[str]:
    """The lines of a stripped text, and again those that close with stops, without them."""
    for line in text.split("\n"):
        line = line.rstrip()
        if line:
            yield line
            bare = line.rstrip(_CLOSE)
            if bare != line and bare:
                yield bare


class Contexts:
    """The known contexts by their keys: a table of slots, and the few keys whose slot another one has."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.int64((1 << max(10, int(8 * len(keys)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, dtype=np.int32)
        at = keys & self.mask
        self.slots[at] = np.arange(len(keys), dtype=np.int32)
        rest = np.nonzero(self.slots[at] != np.arange(len(keys)))[0]
        self.others = rest[np.argsort(keys[rest])]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is unknown."""
        i = self.slots[h & self.mask]
        wrong = np.nonzero(i >= 0)[0]
        wrong = wrong[self.keys[i[wrong]] != h[wrong]]
        i[wrong] = -1
        if len(self.others) and len(wrong):
            own = self.keys[self.others]
            j = np.minimum(np.searchsorted(own, h[wrong]), len(own) - 1)
            i[wrong] = np.where(own[j] == h[wrong], self.others[j], -1)
        return i


def count_positions(texts: list[tuple[str, str]], known: Contexts, totals: np.ndarray) -> None:
    """Add to ``totals`` (contexts x [all, line ends, stops]) the occurrences in whole texts (tail-stripped, kind)."""
    parts, classes = [], []
    for s, kind in texts:
        parts += ["\n", s, "\ue001" if kind else "\ue000"]
        classes += [line_class(line) for line in s.split("\n")]
    c = codes("".join(parts))
    end, silent, brk = np.uint64(0xE000), np.uint64(0xE001), np.uint64(10)
    line = np.cumsum(c == brk) - 1
    nxt = np.r_[c[1:], silent]
    ends = (nxt == brk) | (nxt == end)
    stops = ends.copy()
    for x in _STOPS:
        stops |= nxt == ord(x)
    # where a marked text stops says nothing
    at = np.nonzero((c != end) & (c != silent) & (nxt != silent))[0]
    m, h, n = _mixed(c), _mixed(np.array(classes, dtype=np.uint64))[line[at]], len(known.keys)
    for k in range(1, DEPTH + 1):
        with np.errstate(over="ignore"):
            h = h + m[at - (k - 1)] * _POWER[k]
        i = known.find(h.view(np.int64))
        keep = np.nonzero(i >= 0)[0]
        at, h, i = at[keep], h[keep], i[keep]
        if not len(at):
            return
        for col, hit in enumerate((None, ends[at], stops[at])):
            totals[:, col] += np.bincount(i if hit is None else i[hit], minlength=n)
        more = c[at - (k - 1)] != brk  # a context ends with the break before its line
        at, h = at[more], h[more]


class EndModel:
    """Counts of contexts and of what a longer known context leaves of them."""

    def __init__(self, keys: np.ndarray, parents: np.ndarray, counts: np.ndarray):
        self.known, self.counts, self.rest = Contexts(keys), counts, counts.copy()
        inner = parents >= 0
        np.subtract.at(self.rest, parents[inner], counts[inner])
        n = counts[~inner].sum(axis=0) if len(keys) else np.ones(3)
        self.base = (n + 1) / (n[0] + 10)

    def score(self, lines: list[str], kinds: list[str]) -> np.ndarray:
        """Log-odds that texts with these last lines may end there: each longer context corrects the estimate of the shorter ones."""
        ends = [("\n" + x)[-DEPTH:] for x in lines]
        m, size = _mixed(codes("".join(ends))), np.array([len(x) for x in ends])
        last = np.cumsum(size) - 1
        h = _mixed(np.array([line_class(x) for x in lines], dtype=np.uint64))
        col = np.where(np.array(kinds) == "dots", 2, 1)
        own = np.where(np.array(kinds) == "", 1, 0)  # an unmarked text's own end is among the counts
        path, rows = np.full((len(lines), DEPTH), -1, dtype=np.int64), np.arange(len(lines))
        for k in range(1, DEPTH + 1):
            rows = rows[size[rows] >= k]
            if not len(rows) or not len(self.known.keys):
                break
            with np.errstate(over="ignore"):
                h[rows] += m[last[rows] - (k - 1)] * _POWER[k]
            i = self.known.find(h[rows].view(np.int64))
            path[rows, k - 1] = i
            rows = rows[i >= 0]
        depth, p = (path >= 0).sum(axis=1), self.base[col]
        for k in range(int(depth.max(initial=0))):
            r = np.nonzero(depth > k)[0]
            i, j = path[r, k], col[r]
            left = (depth[r] == k + 1) & (depth[r] < size[r])
            n = np.maximum(0, np.where(left, self.rest[i, 0], self.counts[i, 0]) - own[r])
            e = np.maximum(0, np.where(left, self.rest[i, j], self.counts[i, j]) - own[r])
            p[r] = (e + PRIOR * p[r]) / (n + PRIOR)
        p = np.minimum(p, 1 - 1e-6)
        # no line ends like this: a letter says more than a rare sign
        unknown = np.array([-8.0 if x[-1:].isalnum() else 0.0 for x in lines])
        return np.where(depth > 0, np.log(p / (1 - p)), unknown)


def _batch_contexts(lines: list[str]) -> Iterator[pd.DataFrame]:
    """Distinct contexts of some lines' ends with their numbers, level by level; lines whose context is already alone are not compared any more."""
    ends = [("\n" + x)[-DEPTH:] for x in lines]
    c = codes("".join(ends))
    m = _mixed(c)
    at = np.cumsum([len(x) for x in ends]) - 1
    h = _mixed(np.array([line_class(x) for x in lines], dtype=np.uint64))
    many = np.ones(len(lines), dtype=bool)
    yield pd.DataFrame({"level": [-1], "key": [0], "parent": [0], "n": [len(lines)]})
    for k in range(1, DEPTH + 1):
        before = h
        with np.errstate(over="ignore"):
            h = h + m[at - (k - 1)] * _POWER[k]
        shared, single = np.nonzero(many)[0], np.nonzero(~many)[0]
        order = shared[np.argsort(h[shared])]
        starts = np.nonzero(np.r_[True, h[order[1:]] != h[order[:-1]]])[0] if len(order) else np.empty(0, int)
        n = np.diff(np.r_[starts, len(order)])
        rows = np.r_[order[starts], single]
        yield pd.DataFrame({"level": k - 1, "key": h[rows].view(np.int64), "parent": before[rows].view(np.int64), "n": np.r_[n, np.ones(len(single), int)]})
        many[order[starts[n == 1]]] = False
        more = c[at - (k - 1)] != 10
        at, h, many = at[more], h[more], many[more]
        if not len(at):
            return


def contexts(docs: DataFrame) -> DataFrame:
    """(level, key, parent, n): how many line ends have each context; level -1 has their total."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = [x for text in pdf["text"] for x in line_ends(tail_of(text)[0])]
            if lines:
                yield from _batch_contexts(lines)

    return docs.select("text").where("text is not null").mapInPandas(run, "level int, key long, parent long, n long").groupBy("level", "key").agg(
        F.min("parent").alias("parent"), F.sum("n").alias("n"))


def train(docs: DataFrame, share: float = SHARE, least: int = LEAST) -> EndModel:
    """The model of ``docs``: two aggregations over all texts, of which at most DEPTH / ``share`` rows reach the driver."""
    every = reliable(contexts(docs))
    total = every.where("level = -1").agg(F.sum("n")).first()[0] or 0
    first = every.where((F.col("level") >= 0) & (F.col("n") >= max(least, int(share * total)))).select("level", "key", "parent").toPandas().sort_values(["level", "key"])
    keys, level = first["key"].to_numpy(np.int64), first["level"].to_numpy()
    known, counts = Contexts(keys), np.zeros((len(keys), 3), dtype=np.int64)
    if not len(keys):
        return EndModel(keys, np.empty(0, np.int64), counts)
    parents = np.where(level > 0, known.find(first["parent"].to_numpy(np.int64)), -1)
    model = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(model.value.keys), 3), dtype=np.int64)
        for pdf in batches:
            hand, size = [], 0
            for text in pdf["text"]:
                s = tail_of(text)
                if s[0]:
                    hand.append(s)
                    size += len(s[0])
                if size > _CHUNK:
                    count_positions(hand, model.value, totals)
                    hand, size = [], 0
            if hand:
                count_positions(hand, model.value, totals)
        used = np.nonzero(totals[:, 0])[0]
        yield pd.DataFrame({"i": used, "n": totals[used, 0], "e": totals[used, 1], "s": totals[used, 2]})

    summed = docs.select("text").where("text is not null").mapInPandas(run, "i long, n long, e long, s long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("s").alias("s")).toPandas()
    counts[summed["i"]] = summed[["n", "e", "s"]]
    return EndModel(keys, parents, counts)


def scored(docs: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(doc_id, lang, source, tail, kind, log_odds) of every document with visible text; the whole text is read, its last line judged."""
    docs = spread(docs.select("doc_id", "lang", "source", "text"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, share, least))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cut = [tail_of(s) for s in pdf["text"]]
            pdf, cut = pdf[[bool(s) for s, _ in cut]].drop(columns="text"), [x for x in cut if x[0]]
            if cut:
                lines, kinds = [s.rsplit("\n", 1)[-1] for s, _ in cut], [k for _, k in cut]
                yield pdf.assign(tail=[x[-DEPTH:] for x in lines], kind=kinds, log_odds=model.value.score(lines, kinds))

    return docs.where("text is not null").mapInPandas(run, "doc_id long, lang string, source string, tail string, kind string, log_odds double")


def valley(h: np.ndarray) -> float:
    """The least crowded point between the two kinds of texts of a histogram.

    The kinds are parted where the variance between them is greatest; the point lies between their means, in the middle
    of the emptiest stretch. Without texts below ``EVEN`` it is the middle of what lies below.
    """
    at = LOW + STEP * (np.arange(len(h)) + 0.5)
    n, mass = np.cumsum(h), np.cumsum(h * at)
    below = np.nonzero((at < EVEN) & (n > 0) & (n < n[-1]))[0]
    low, high = LOW, EVEN
    if len(below):
        own, other = mass[below] / n[below], (mass[-1] - mass[below]) / (n[-1] - n[below])
        k = int(np.argmax(n[below] * (n[-1] - n[below]) * (own - other) ** 2))
        low, high = own[k], min(EVEN, other[k])
    smooth = np.convolve(h, [1, 2, 3, 4, 3, 2, 1], "same")  # a stretch of a few bins, not a chance hole
    inside = np.nonzero((at > low) & (at < high))[0]
    if not len(inside):
        return float((low + high) / 2)
    return float(np.median(at[inside[smooth[inside] == smooth[inside].min()]]))


def thresholds(rows: DataFrame) -> tuple[float, DataFrame]:
    """The point of ``valley`` over all rows, and (lang, own) of each language.

    A histogram has 64 bins. A language's own point counts by its texts, the point of all as ``COMMON`` texts, so a growing
    language moves smoothly from the one to the other.
    """
    bins = int((HIGH - LOW) / STEP)
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("log_odds") - LOW) / STEP))).cast("int")
    binned = reliable(rows.groupBy("lang", at.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    every = np.zeros(bins)
    for r in binned.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        every[r.bin] = r.n
    common = valley(every) if every.any() else (LOW + EVEN) / 2

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros(bins)
        h[pdf["bin"]] = pdf["n"]
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "own": [(h.sum() * valley(h) + COMMON * common) / (h.sum() + COMMON)]})

    return common, binned.where("lang is not null").groupBy("lang").applyInPandas(own, "lang string, own double")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, kind, log_odds, truncated). Null and blank texts are whole and left out.

    Equal texts get equal verdicts; a language or source may be null. An empty table gives no row.
    """
    rows = written(scored(docs))
    common, own = thresholds(rows)
    limit = F.coalesce("own", F.lit(common))
    return salted_join(rows, own, ["lang"], "left").withColumn("truncated", F.coalesce(F.col("log_odds") < limit, F.lit(False))).drop("own")


def p8_found(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).where("truncated").select("doc_id")


def p8_rates(spark, sf_dir: str) -> DataFrame:
    """Share of cut documents per source."""
    docs = table(spark, sf_dir, "documents")
    cut = judged(docs).groupBy("source").agg(F.count_if("truncated").alias("n_truncated"))
    every = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    return every.join(cut, every["source"].eqNullSafe(cut["source"]), "left").select(
        every["source"], "n_docs", F.coalesce("n_truncated", F.lit(0)).alias("n_truncated"), (F.coalesce("n_truncated", F.lit(0)) / F.col("n_docs")).alias("rate"))
