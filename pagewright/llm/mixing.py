"""Mixing sources to target weights by balanced sampling with the cube method.

A source that must hold r times its tokens gives every document floor(r) times, and once more with the
probability r - floor(r). Which documents come once more is drawn by the cube method: within blocks of bounded size
the probabilities move along the null space of the constraints (tokens, documents), so both totals stay
exact, until at most two documents of a block are undecided; those, and a few of the block's smallest, form the next round's blocks. A
source's last block lands: the largest document is decided first, and all others move a little so that both totals stay, until
one small document is left.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.tokenizer import encoded
from pagewright.session import reliable, table, written

#: Documents in a block, and the smallest of them that the flight leaves for the last block.
BLOCK, KEPT = 2000, 4
_NEAR = 1e-9


def flight(sizes: list[float], probs: list[float], rng: random.Random) -> list[float]:
    """Move ``probs`` within [0, 1] keeping sum(p) and sum(size * p), until at most two are strictly inside."""
    p = list(probs)
    open_ = [i for i in range(len(p)) if _NEAR < p[i] < 1 - _NEAR]
    nxt, hand = 0, []
    while True:
        while len(hand) < 3 and nxt < len(open_):
            hand.append(open_[nxt])
            nxt += 1
        if len(hand) < 3 and not (len(hand) == 2 and sizes[hand[0]] == sizes[hand[1]]):
            return p
        if len(hand) == 2 or len({sizes[i] for i in hand}) == 1:
            way = [1.0, -1.0, 0.0][: len(hand)]
        else:
            a, b, c = (sizes[i] for i in hand)
            top = max(abs(b - c), abs(c - a), abs(a - b))
            way = [(b - c) / top, (c - a) / top, (a - b) / top]
        steps = []
        for sign in (1.0, -1.0):
            steps.append(min(((1 - p[i]) if sign * d > 0 else p[i]) / abs(d) for i, d in zip(hand, way, strict=True) if d))
        up, down = steps
        by = up if rng.random() * (up + down) < down else -down
        for i, d in zip(hand, way, strict=True):
            p[i] += by * d
            if p[i] < _NEAR or p[i] > 1 - _NEAR:
                p[i] = float(round(p[i]))
        hand = [i for i in hand if 0.0 < p[i] < 1.0]


def landing(sizes: list[float], probs: list[float], rng: random.Random) -> list[float]:
    """Decide what is left, keeping each probability in the mean: the largest moves, the others keep the totals.

    The others' way is the shortest that keeps the tokens and the number of documents, or the tokens alone where both
    cannot be kept. At most one document, mostly the smallest, is drawn without balance.
    """
    p, s = np.array(probs, dtype=float), np.array(sizes, dtype=float)
    while True:
        p[p < _NEAR], p[p > 1 - _NEAR] = 0.0, 1.0
        left = np.nonzero((p > 0) & (p < 1))[0]
        if not len(left):
            return p.tolist()
        first, rest = left[np.argmax(s[left])], left[left != left[np.argmax(s[left])]]
        way = np.zeros(len(p))
        way[first] = 1.0
        for keep in (np.array([s[rest], np.ones(len(rest))]), np.array([s[rest]])):
            if len(rest) >= len(keep):
                moved = np.linalg.lstsq(keep, -np.array([s[first], 1.0])[: len(keep)], rcond=None)[0]
                if np.allclose(keep @ moved, -np.array([s[first], 1.0])[: len(keep)], rtol=1e-6):
                    way[rest] = moved
                    break
        at = np.nonzero(way)[0]
        steps = [np.min(np.where(sign * way[at] > 0, 1 - p[at], p[at]) / np.abs(way[at])) for sign in (1.0, -1.0)]
        p[at] += (steps[0] if rng.random() * sum(steps) < steps[1] else -steps[1]) * way[at]


def _flyer(seed: int, turn: int):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id"], ascending=False, ignore_index=True)
        rng = random.Random(f"{seed} {turn} {pdf['source'].iloc[0]} {pdf['block'].iloc[0]}")
        sizes, probs, fly = pdf["size"].tolist(), pdf["prob"].tolist(), max(0, len(pdf) - KEPT)
        if pdf["blocks"].iloc[0] == 1:
            probs = landing(sizes, probs, rng)
        else:
            probs = flight(sizes[:fly], probs[:fly], rng) + probs[fly:]
        return pdf.assign(prob=probs)[["doc_id", "source", "size", "prob"]]

    return fly


def cube_sample(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, extra): ``extra`` is 1 for drawn and 0 for other rows of (doc_id, source, size, prob).

    Balanced on documents and sizes within each source; a source of any size is spread over blocks of about
    ``BLOCK`` rows, six of which at most go on to the next round. doc_id must be unique. Sources are those of a list of
    targets, so the blocks' numbers are broadcast, one row a source.
    """
    done, left, turn = None, docs.select("doc_id", "source", F.col("size").cast("double").alias("size"), F.col("prob").cast("double").alias("prob")), 0
    schema = "doc_id long, source string, size double, prob double"
    while True:
        blocks = left.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
        rows = left.join(F.broadcast(blocks), "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed + turn), F.col("doc_id")), F.col("blocks")))

        flown = reliable(rows.groupBy("source", "block").applyInPandas(_flyer(seed, turn), schema))
        inside = (F.col("prob") > 0) & (F.col("prob") < 1)
        decided = flown.where(~inside)
        done = decided if done is None else done.unionByName(decided)
        left, turn = flown.where(inside), turn + 1
        if left.isEmpty():
            return done.select("doc_id", "source", F.col("size").cast("long").alias("size"), F.col("prob").cast("int").alias("extra"))


def plan(sizes: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, dict]:
    """Per target source its scaled share, wanted tokens and rate (wanted / own tokens).

    ``sizes`` has (documents, tokens) of the sources, ``targets`` (share, most repeats). Sources without tokens, share or
    repeats can give nothing; the others' shares are scaled to sum to 1. Without ``total`` it is the most tokens at which
    every source holds its share exactly; with it, a source that cannot reach its part gives all it may.
    """
    able = {s: t for s, t in targets.items() if t[0] and t[0] > 0 and t[1] and t[1] > 0 and sizes.get(s, (0, 0))[1] > 0}
    whole = sum(share for share, _ in able.values()) or 1.0
    most = min((sizes[s][1] * r / (share / whole) for s, (share, r) in able.items()), default=0.0)
    out = {}
    for s, (share, r) in targets.items():
        if s in able:
            wanted = min(share / whole * (total if total is not None else most), sizes[s][1] * r)
            out[s] = {"scaled": share / whole, "wanted": wanted, "rate": wanted / sizes[s][1]}
        else:
            out[s] = {"scaled": 0.0, "wanted": 0.0, "rate": 0.0}
    return out


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the drawn documents of ``docs`` (doc_id, source, n_tokens).

    ``targets`` is (source, target_share, max_repeats), one row a source: a short list by its nature, read to the
    driver. Rows with a null source, a source without target or no tokens are never drawn. Empty tables give no row.
    """
    wish = {r.source: (r.target_share, r.max_repeats) for r in targets.where("source is not null").collect()}
    docs = docs.where(F.col("source").isin(list(wish)) & (F.col("n_tokens") > 0)) if wish else docs.where("false")
    sizes = {r.source: (r.n, r.t) for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    rates = plan(sizes, wish, total)
    base, prob = F.lit(0), F.lit(0.0)
    for s, x in rates.items():
        whole = int(x["rate"] + _NEAR)
        rest = x["rate"] - whole
        base = F.when(F.col("source") == s, whole).otherwise(base)
        prob = F.when(F.col("source") == s, rest if rest > _NEAR else 0.0).otherwise(prob)
    rows = docs.select("doc_id", "source", "n_tokens", base.alias("base"), prob.alias("prob"))
    drawn = cube_sample(rows.where("prob > 0").withColumn("size", F.col("n_tokens")), seed)
    more = rows.where("prob > 0").drop("n_tokens").join(drawn.select("doc_id", F.col("size").alias("n_tokens"), "extra"), "doc_id")
    every = rows.where("prob = 0").select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens"), "base").withColumn("extra", F.lit(0))
    return every.unionByName(more.select("doc_id", "source", "n_tokens", "base", "extra")).select(
        "doc_id", "source", "n_tokens", (F.col("base") + F.col("extra")).cast("int").alias("repeats")).where("repeats > 0")


def _sized(spark, sf_dir: str) -> DataFrame:
    return written(encoded(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), out="n_tokens", counts_only=True))


def p7_mix(spark, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def shares(drawn: DataFrame, docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Of every target source its target share, its share scaled to the sources that can give, the actual one, and how far the tokens miss.

    ``token_error`` is drawn minus wanted tokens in parts of the wanted ones, null where none are wanted.
    """
    wish = {r.source: (r.target_share, r.max_repeats) for r in targets.where("source is not null").collect()}
    own = docs.where(F.col("source").isin(list(wish)) & (F.col("n_tokens") > 0)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect() if wish else []
    rates = plan({r.source: (r.n, r.t) for r in own}, wish, total)
    wanted = docs.sparkSession.createDataFrame([(s, x["scaled"], x["wanted"]) for s, x in rates.items()], "source string, scaled_share double, wanted_tokens double")
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("repeats").alias("n_draws"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"))
    rows = reliable(targets.join(wanted, "source", "left").join(got, "source", "left").fillna(0, ["n_docs", "n_draws", "most_repeats", "n_tokens"]))
    every = rows.agg(F.sum("n_tokens")).first()[0] or 1
    return rows.withColumns({"actual_share": F.col("n_tokens") / F.lit(every), "token_error": F.col("n_tokens") / F.nullif(F.col("wanted_tokens"), F.lit(0.0)) - 1})


def p7_shares(spark, sf_dir: str) -> DataFrame:
    docs, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return shares(mix(docs, targets), docs, targets)
