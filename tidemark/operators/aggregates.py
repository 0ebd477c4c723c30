"""Aggregate functions of one's own, in three levels: states of a task's rows, of a key's parts, and of the key.

An aggregate has a state that takes up arrays of values and merges with others. Tasks fold their rows into one state a key, an Arrow batch at a
time, and hand on the states alone; those of a key are merged in parts first, so no key's states meet in one task all at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a task holds states of at a time.
MOST_KEYS = 10_000


class Aggregate(Protocol):
    """``result`` is the schema of ``finish``; a state is whatever can be pickled."""

    result: str

    def zero(self) -> object: ...
    def add(self, state: object, values: np.ndarray) -> object: ...
    def merge(self, a: object, b: object) -> object: ...
    def finish(self, state: object) -> tuple: ...


def aggregated(df: DataFrame, by: str, value: str, aggregate: Aggregate, parts: int = 64) -> DataFrame:
    """by and the aggregate's result over the non-null values of each key; a null key is a key, a key without values has none."""
    kind = dict(df.dtypes)[by]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for batch in batches:
            for key, values in batch.groupby("k", dropna=False, sort=False).v:
                key = None if pd.isna(key) else key
                states[key] = aggregate.add(states[key] if key in states else aggregate.zero(), values.to_numpy(dtype=np.float64))
            if len(states) > MOST_KEYS:
                yield out(states)
                states = {}
        if states:
            yield out(states)

    def out(states: dict) -> pd.DataFrame:
        part = TaskContext.get().partitionId() % parts
        return pd.DataFrame({"k": pd.Series(list(states), dtype=object), "part": part, "state": [pickle.dumps(s) for s in states.values()]})

    def folded(rows: pd.DataFrame) -> object:
        state = aggregate.zero()
        for data in rows.state:
            state = aggregate.merge(state, pickle.loads(data))
        return state

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": rows.k.iloc[:1].to_numpy(), "state": [pickle.dumps(folded(rows))]})

    names = [c.split()[0] for c in aggregate.result.split(", ")]

    def final(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(rows.k.iloc[0], *aggregate.finish(folded(rows)))], columns=[by, *names])

    values = df.select(F.col(by).alias("k"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    states = values.mapInPandas(partial, f"k {kind}, part int, state binary")
    return states.groupBy("k", "part").applyInPandas(merged, f"k {kind}, state binary").groupBy("k").applyInPandas(final, f"{by} {kind}, {aggregate.result}")


class TDigest:
    """Quantiles by a digest of weighted means that are fine at both ends (scale function k1): about ``size`` means, whatever the rows.

    The rank of an estimate is within about pi * sqrt(p (1 - p)) / size of p.
    """

    def __init__(self, shares: tuple[float, ...], size: int = 200) -> None:
        self.shares, self.size = shares, size
        self.result = ", ".join(["n long", "low double", "high double", *(f"q{round(p * 1000):03d} double" for p in shares)])

    def zero(self) -> tuple:
        return np.zeros(0), np.zeros(0), np.inf, -np.inf

    def _squeezed(self, means: np.ndarray, weights: np.ndarray, low: float, high: float) -> tuple:
        order = np.argsort(means, kind="stable")
        means, weights = means[order], weights[order]
        upto = np.cumsum(weights)
        middle = np.clip((upto - weights / 2) / upto[-1], 0, 1)
        cell = np.floor(self.size / 2 * (np.arcsin(2 * middle - 1) / np.pi + 0.5)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        total = np.add.reduceat(weights, first)
        return np.add.reduceat(means * weights, first) / total, total, low, high

    def add(self, state: tuple, values: np.ndarray) -> tuple:
        means, weights, low, high = state
        return self._squeezed(np.r_[means, values], np.r_[weights, np.ones(len(values))], min(low, values.min()), max(high, values.max()))

    def merge(self, a: tuple, b: tuple) -> tuple:
        if not len(a[0]) or not len(b[0]):
            return b if len(b[0]) else a
        return self._squeezed(np.r_[a[0], b[0]], np.r_[a[1], b[1]], min(a[2], b[2]), max(a[3], b[3]))

    def finish(self, state: tuple) -> tuple:
        means, weights, low, high = state
        n = weights.sum()
        middle = (np.cumsum(weights) - weights / 2) / n
        at = np.interp(self.shares, np.r_[0, middle, 1], np.r_[low, means, high])
        return int(n), float(low), float(high), *map(float, at)


class Moments:
    """n, mean, variance, skewness and excess kurtosis of all values, by central moments that merge exactly."""

    result = "n long, mean double, variance double, skewness double, kurtosis double"

    def zero(self) -> tuple:
        return 0, 0.0, 0.0, 0.0, 0.0

    def add(self, state: tuple, values: np.ndarray) -> tuple:
        mean = values.mean()
        off = values - mean
        return self.merge(state, (len(values), float(mean), float((off**2).sum()), float((off**3).sum()), float((off**4).sum())))

    def merge(self, a: tuple, b: tuple) -> tuple:
        if not a[0] or not b[0]:
            return a if a[0] else b
        n, d = a[0] + b[0], b[1] - a[1]
        p, q = a[0] / n, b[0] / n
        return (
            n,
            a[1] + d * q,
            a[2] + b[2] + d**2 * n * p * q,
            a[3] + b[3] + d**3 * n * p * q * (p - q) + 3 * d * (p * b[2] - q * a[2]),
            a[4] + b[4] + d**4 * n * p * q * (p * p - p * q + q * q) + 6 * d**2 * (p * p * b[2] + q * q * a[2]) + 4 * d * (p * b[3] - q * a[3]),
        )

    def finish(self, state: tuple) -> tuple:
        n, mean, m2, m3, m4 = state
        flat = m2 == 0
        return n, mean, m2 / n, None if flat else (m3 / n) / (m2 / n) ** 1.5, None if flat else n * m4 / m2**2 - 3
