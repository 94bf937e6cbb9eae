"""Sequential steps over small groups: one pass over sorted partitions instead of one pandas call a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Rows of a sorted frame at which a new group begins; nulls are equal."""
    change = np.zeros(len(pdf), dtype=bool)
    for k in keys:
        code = pd.factorize(pdf[k], use_na_sentinel=False)[0]
        change[1:] |= code[1:] != code[:-1]
    change[:1] = True
    return np.nonzero(change)[0]


def grouped(rows: DataFrame, keys: list[str], order: list, step: Callable[[dict[str, np.ndarray]], dict[str, list]], schema: str) -> DataFrame:
    """``step`` on the columns of each group of ``keys`` in ``order``, whose lists are the output columns of ``schema``.

    One shuffle by the keys and one sort; a partition is read batch by batch and only the group that a batch cuts is held over, so
    memory is bounded by the greatest group (a sheet, or a book's labels). Every group has at least one row; an empty table gives no row.
    """
    names = [part.split()[0].strip("`") for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
            cols, out = {c: pdf[c].to_numpy() for c in pdf.columns}, {c: [] for c in names}
            for a, b in zip(starts, np.r_[starts[1:], len(pdf)], strict=True):
                for c, values in step({k: v[a:b] for k, v in cols.items()}).items():
                    out[c].extend(values)
            if out[names[0]]:  # an empty frame has no types
                yield pd.DataFrame(out)

        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            if held and len(_starts(pd.concat([held[-1].tail(1), pdf])[keys], keys)) == 1:
                held.append(pdf)  # the same group goes on
                continue
            whole = pd.concat([*held, pdf], ignore_index=True) if held else pdf
            starts = _starts(whole, keys)
            held = [whole.iloc[starts[-1]:]]
            if starts[-1]:
                yield from done(whole.iloc[:starts[-1]], starts[:-1])
        if held:
            yield from done(pd.concat(held, ignore_index=True), np.array([0]))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def fields(rows: DataFrame, *more: str) -> str:
    """The schema of ``rows`` with further columns, as DDL."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *more])


def repeated(group: dict[str, np.ndarray], keys: list[str], n: int = 1) -> dict[str, list]:
    """The group's keys ``n`` times."""
    return {k: [group[k][0]] * n for k in keys}
