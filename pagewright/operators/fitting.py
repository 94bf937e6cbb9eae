"""Settings as data, and the search for better ones: validation, screening, coordinate descent, an evolution strategy; a logistic ranker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Knob:
    """A number that the layout rules depend on, with its default and bounds."""

    name: str
    default: float
    low: float
    high: float
    whole: bool = False

    def clamp(self, v: float) -> float:
        v = min(self.high, max(self.low, v))
        return float(round(v)) if self.whole else float(v)

    def encode(self, v: float) -> float:
        """The value's place between the bounds, 0 to 1."""
        return (self.clamp(v) - self.low) / (self.high - self.low) if self.high > self.low else 0.0

    def decode(self, u: float) -> float:
        return self.clamp(self.low + min(1.0, max(0.0, u)) * (self.high - self.low))


#: The limits of ``pages`` and ``parts`` that may be searched.
KNOBS = (Knob("CHANNEL", 10.0, 4.0, 24.0), Knob("SPREAD", 12.0, 4.0, 30.0), Knob("OPEN", 0.5, 0.2, 0.9), Knob("PAIRED", 0.35, 0.1, 0.8), Knob("COLUMN_LINES", 4, 2, 10, True), Knob("HANGING", 26.0, 10.0, 60.0),
         Knob("LEADING", 1.55, 1.1, 2.5), Knob("INDENT", 18.0, 6.0, 40.0), Knob("FLOW", 90.0, 30.0, 200.0), Knob("HEADING", 1.15, 1.02, 1.6), Knob("PAD", 8.0, 0.0, 16.0))


def profile(values: dict[str, float], knobs: tuple[Knob, ...] = KNOBS, strict: bool = True) -> dict[str, float]:
    """All knobs with ``values`` put in; unknown names and values out of bounds are refused, or without ``strict`` dropped and clamped."""
    known = {k.name: k for k in knobs}
    bad = [n for n in values if n not in known] + [n for n, v in values.items() if n in known and not known[n].low <= v <= known[n].high]
    if bad and strict:
        raise ValueError(f"not a setting, or out of its bounds: {', '.join(sorted(bad))}")
    return {k.name: k.clamp(values.get(k.name, k.default)) for k in knobs}


def changed(values: dict[str, float], knobs: tuple[Knob, ...] = KNOBS) -> dict[str, float]:
    """The settings that differ from their defaults: what a stored profile holds."""
    return {k.name: values[k.name] for k in knobs if k.name in values and values[k.name] != k.default}


#: Losses of a list of settings; evaluated together, so that one job can score a table of candidates.
Loss = Callable[[list[dict[str, float]]], list[float]]


def screen(loss: Loss, knobs: tuple[Knob, ...] = KNOBS, start: dict[str, float] | None = None) -> list[tuple[str, float]]:
    """(knob, span of the loss between its bounds and its value), greatest first; knobs without effect are left out."""
    base = profile(start or {}, knobs)
    trials = [base | {k.name: v} for k in knobs for v in (k.low, base[k.name], k.high)]
    got = np.array(loss(trials)).reshape(-1, 3)
    spans = [(k.name, float(np.ptp(v))) for k, v in zip(knobs, got, strict=True)]
    return sorted([s for s in spans if s[1] > 0], key=lambda s: -s[1])


def coordinate_descent(loss: Loss, names: list[str], knobs: tuple[Knob, ...] = KNOBS, start: dict[str, float] | None = None, allowed: Callable[[dict[str, float]], bool] | None = None,
                       budget: int = 10_000) -> tuple[dict[str, float], float]:
    """The best settings and their loss: of each knob in turn seven values over its range, then half a step to either side; improvements that are ``allowed`` stay."""
    by = {k.name: k for k in knobs}
    best = profile(start or {}, knobs)
    least, spent = loss([best])[0], 1
    for name in names:
        k = by[name]
        grid = [k.decode(i / 6) for i in range(7)]
        for values in (grid, None):
            trials = [best | {name: v} for v in (values or [k.decode(k.encode(best[name]) + s / 12) for s in (-1, 1)])]
            if spent + len(trials) > budget:
                return best, least
            spent += len(trials)
            for t, v in sorted(zip(trials, loss(trials), strict=True), key=lambda x: x[1]):
                if v < least and (allowed is None or allowed(t)):
                    best, least = t, v
                    break
    return best, least


def evolve(loss: Loss, names: list[str], knobs: tuple[Knob, ...] = KNOBS, start: dict[str, float] | None = None, sigma: float = 0.2, budget: int = 400, seed: int = 1, least_sigma: float = 1e-3) -> tuple[dict[str, float], float]:
    """The best settings that a separable evolution strategy with adapted step sizes finds within ``budget`` losses; a generation is scored at once.

    The mean moves in the unit cube of the knobs; a variance of each knob and the common step size follow the evolution paths.
    """
    own = [k for k in knobs if k.name in names]
    base, n, rng = profile(start or {}, knobs), len(own), np.random.default_rng(seed)
    lam = 4 + int(3 * np.log(n))
    mu = lam // 2
    w = np.log(mu + 0.5) - np.log(np.arange(1, mu + 1))
    w /= w.sum()
    eff = 1 / (w**2).sum()
    cs, cc = (eff + 2) / (n + eff + 5), 4 / (n + 4)
    c1, cmu = 2 / ((n + 1.3) ** 2 + eff), min(0.9, 2 * (eff - 2 + 1 / eff) / ((n + 2) ** 2 + eff) * (n + 2) / 3)
    damp, chi = 1 + cs + 2 * max(0.0, np.sqrt((eff - 1) / (n + 1)) - 1), np.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))
    mean, var, ps, pc = np.array([k.encode(base[k.name]) for k in own]), np.ones(n), np.zeros(n), np.zeros(n)
    best, least, spent = base, loss([base])[0], 1
    while sigma > least_sigma and spent + lam <= budget:
        z = rng.standard_normal((lam, n))
        x = np.clip(mean + sigma * np.sqrt(var) * z, 0, 1)
        trials = [base | {k.name: k.decode(u) for k, u in zip(own, row, strict=True)} for row in x]
        got = np.array(loss(trials))
        spent += lam
        order = np.argsort(got, kind="stable")
        if got[order[0]] < least:
            best, least = trials[order[0]], float(got[order[0]])
        step = ((x[order[:mu]] - mean) / sigma * w[:, None]).sum(axis=0)
        mean = mean + sigma * step
        ps = (1 - cs) * ps + np.sqrt(cs * (2 - cs) * eff) * step / np.sqrt(var)
        pc = (1 - cc) * pc + np.sqrt(cc * (2 - cc) * eff) * step
        spread = (((x[order[:mu]] - mean + sigma * step) / sigma) ** 2 * w[:, None]).sum(axis=0)
        var = np.maximum(1e-12, (1 - c1 - cmu) * var + c1 * pc**2 + cmu * spread)
        sigma *= float(np.exp(min(1.0, cs / damp * (np.linalg.norm(ps) / chi - 1))))
    return best, least


def squash(x: Column, scale: float) -> Column:
    """x / (x + scale): 0 at 0, a half at ``scale``, towards 1; negative values mirror."""
    return x / (F.abs(x) + F.lit(scale))


def pair_features(pairs: DataFrame) -> DataFrame:
    """``pairs`` (gated pairs with drift, reach, cost, labels and percent boxes) with ``features``: an array of numbers around 0 to 1."""
    el, rl = F.nullif("e_label", F.lit("")), F.nullif("r_label", F.lit(""))
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    inside = (F.col("reach") == 0) & F.col("y").between(F.col("top"), F.col("bottom"))
    parts = [squash(F.coalesce("drift", F.lit(100.0)), 5.0), squash(F.coalesce("reach", F.lit(100.0)), 10.0), squash(F.coalesce("cost", F.lit(150.0)), 10.0), F.coalesce(inside, F.lit(False)).cast("double"),
             F.coalesce((el == rl), F.lit(False)).cast("double"), F.coalesce((el != rl), F.lit(False)).cast("double"), el.isNull().cast("double"), rl.isNull().cast("double"), squash(w, 40.0), squash(h, 20.0), squash(w * h, 1000.0)]
    return pairs.withColumn("features", F.array(*[p.cast("double") for p in parts]))


def sigmoid(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)) without overflow."""
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def train_logistic(rows: DataFrame, features: str = "features", label: str = "y", rounds: int = 100, rate: float = 1.0, l2: float = 1e-3, seed: int = 1) -> list[float]:
    """Weights of a logistic model, the bias first: full-batch gradient descent, both classes weighing the same, the bias not regularised.

    A round is one aggregation of partial gradients; a row a partition comes to the driver. Without rows, or with one class only, the weights stay at their
    seeded start.
    """
    own = rows.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(features).alias("x"), F.col(label).cast("int").alias("y")).persist()
    head = own.first()
    width = len(head.x) if head else 0
    n = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    w = np.r_[0.0, np.random.default_rng(seed).normal(0, 0.01, width)]
    if n.get(0) and n.get(1):
        cost = {y: 0.5 / n[y] for y in (0, 1)}
        for _ in range(rounds):
            now = w.copy()

            def partial(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
                g = np.zeros(width + 1)
                for pdf in batches:
                    if len(pdf):
                        x = np.c_[np.ones(len(pdf)), np.stack(pdf["x"].to_numpy())]
                        y = pdf["y"].to_numpy()
                        g += ((sigmoid(x @ now) - y) * np.where(y == 1, cost[1], cost[0])) @ x
                yield pd.DataFrame({"g": [g.tolist()]})

            g = sum((np.array(r.g) for r in own.mapInPandas(partial, "g array<double>").collect()), np.zeros(width + 1))
            w -= rate * (g + l2 * np.r_[0.0, w[1:]])
    own.unpersist()
    return w.tolist()


def scored(rows: DataFrame, weights: list[float], features: str = "features") -> DataFrame:
    """``rows`` with ``p``, the model's probability, computed without Python and without overflow."""
    z = F.aggregate(F.zip_with(F.col(features), F.array(*[F.lit(v) for v in weights[1:]]), lambda a, b: a * b), F.lit(float(weights[0])), lambda acc, v: acc + v)
    e = F.exp(-F.abs(F.col("_z")))
    return rows.withColumn("_z", z).withColumn("p", F.when(F.col("_z") >= 0, 1 / (1 + e)).otherwise(e / (1 + e))).drop("_z")


def examples(pairs: DataFrame, links: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` with ``y`` (linked or claimed) and ``cost`` infinite where unknown; only pages with entries are there, and anchored regions are left out."""
    true = links.select(*keys, "entry_ord", "region_ord").union(claims.select(*keys, "entry_ord", "region_ord")).distinct().withColumn("y", F.lit(True))
    own = pairs.where("not bound") if "bound" in pairs.columns else pairs
    return own.join(true, [*keys, "entry_ord", "region_ord"], "left").withColumns({"y": F.coalesce("y", F.lit(False)), "cost": F.coalesce("cost", F.lit(float("inf")))})
