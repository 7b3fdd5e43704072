"""Differentially private aggregates: Laplace noise from a seed, as plain expressions over the exact aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def laplace(scale: float, seed: int) -> Column:
    """One draw for each row."""
    u = F.rand(seed) - 0.5
    return F.lit(-scale) * F.signum(u) * F.log1p(-2 * F.abs(u))


def private_counts(df: DataFrame, by: str, epsilon: float, seed: int, least: int = 5) -> DataFrame:
    """Noisy counts by bin, rounded and not below 0; bins of fewer than `least` are suppressed first."""
    exact = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return exact.select(by, F.greatest(F.lit(0), F.round(F.col("n") + laplace(1 / epsilon, seed)).cast("long")).alias("n"))


def private_mean(df: DataFrame, value: str, low: float, high: float, epsilon: float, seed: int) -> DataFrame:
    """A10: noisy sum and mean of values clipped to [low, high]; the mean's sensitivity is (high - low) / n."""
    clipped = F.least(F.lit(high), F.greatest(F.lit(low), F.col(value)))
    exact = df.agg(F.sum(clipped).alias("s"), F.count(value).alias("n"))
    return exact.select((F.col("s") + laplace(max(abs(low), abs(high)) / epsilon, seed)).alias("total"), (F.col("s") / F.col("n") + laplace(1.0, seed + 1) * (high - low) / F.col("n") / epsilon).alias("mean"))
