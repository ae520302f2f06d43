"""Ranking metrics over ``ranked`` and ``relevant`` arrays, and a bootstrap mean."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at_k(ranked: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant in the first k; 0 where either is empty."""
    if k < 0:
        raise ValueError("k must not be negative")
    found = F.size(F.array_intersect(F.slice(ranked, 1, k), relevant))
    n = F.size(F.array_distinct(relevant))
    return F.when((n > 0) & (F.size(ranked) > 0), found / n).otherwise(F.lit(0.0))


def _first_hit(ranked: Column, relevant: Column) -> Column:
    return F.array_position(F.transform(ranked, lambda x: F.array_contains(relevant, x)), True)


def reciprocal_rank(ranked: Column, relevant: Column) -> Column:
    """One over the place of the first relevant item, 0 if there is none."""
    at = F.coalesce(_first_hit(ranked, relevant), F.lit(0))
    return F.when(at > 0, 1.0 / at).otherwise(F.lit(0.0))


def dcg(gains: Column) -> Column:
    """Sum of gain / log2(place + 1)."""
    at = F.transform(gains, lambda g, i: g.cast("double") / F.log2(i + F.lit(2.0)))
    return F.aggregate(at, F.lit(0.0), lambda s, x: s + x)


def ndcg_at_k(ranked: Column, relevant: Column, k: int = 10) -> Column:
    """Binary nDCG; the ideal has min(relevant, k) hits first."""
    if k < 0:
        raise ValueError("k must not be negative")
    gains = F.transform(F.slice(ranked, 1, k), lambda x: F.array_contains(relevant, x).cast("int"))
    ideal = F.least(F.size(F.array_distinct(relevant)), F.lit(k))
    best = dcg(F.when(ideal > 0, F.array_repeat(F.lit(1), ideal)).otherwise(F.array().cast("array<int>")))
    return F.when(best > 0, dcg(gains) / best).otherwise(F.lit(0.0))


#: The metrics every evaluation reports.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "recall@1": lambda r, q: recall_at_k(r, q, 1),
    "recall@5": lambda r, q: recall_at_k(r, q, 5),
    "recall@10": lambda r, q: recall_at_k(r, q, 10),
    "MRR": reciprocal_rank,
    "nDCG@10": lambda r, q: ndcg_at_k(r, q, 10),
}


def bootstrap_mean(values: np.ndarray, confidence: float = 0.95, n_boot: int = 10_000, seed: int = 0) -> tuple[float, float, float]:
    """(mean, low, high) by percentiles of resampled means; one value is its own interval."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    if len(values) == 0:
        raise ValueError("no values")
    mean = float(values.mean())
    if len(values) == 1:
        return mean, mean, mean
    rng = np.random.default_rng(seed)
    # in blocks of resamples, so that memory does not grow with resamples x values
    block = max(1, 4_000_000 // len(values))
    means = np.concatenate([values[rng.integers(0, len(values), size=(min(block, n_boot - at), len(values)))].mean(axis=1) for at in range(0, n_boot, block)])
    tail = (1 - confidence) / 2
    low, high = np.quantile(means, [tail, 1 - tail])
    return mean, float(low), float(high)


def mean_ci(rows: DataFrame, keys: list[str], value: str, *, confidence: float = 0.95, n_boot: int = 10_000, seed: int = 0) -> DataFrame:
    """Per group of ``keys``: n, mean, ci_lo and ci_hi, the percentiles of resampled means; nulls are left out.

    A resample of n values is a multinomial draw of how often each distinct
    value comes, so the rows are first counted by value, and a group is as
    many rows as it has distinct values (ranking metrics have few).  One
    method for groups of any size; ``bootstrap_mean`` draws the values
    themselves, to the same distribution.  One value is its own interval.
    """
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    names = [*keys, "n", "mean", "ci_lo", "ci_hi"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__x")
        x, times = pdf["__x"].to_numpy(), pdf["__n"].to_numpy()
        n = int(times.sum())
        mean = float(x @ times / n)
        if len(x) == 1:
            return pd.DataFrame([[*key, n, mean, mean, mean]], columns=names)
        rng = np.random.default_rng(seed)
        block = max(1, 2_000_000 // len(x))
        means = np.concatenate([rng.multinomial(n, times / n, size=min(block, n_boot - at)) @ x / n for at in range(0, n_boot, block)])
        tail = (1 - confidence) / 2
        low, high = np.quantile(means, [tail, 1 - tail])
        return pd.DataFrame([[*key, n, mean, float(low), float(high)]], columns=names)

    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["n bigint", "mean double", "ci_lo double", "ci_hi double"])
    return counted.groupBy(*keys).applyInPandas(one, schema)
