"""Aggregates and score maps as Column expressions. Logarithms are natural."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def nan() -> Column:
    return F.lit(float("nan"))


def or_nan(x: Column) -> Column:
    """An aggregate of nothing is NaN here, not null."""
    return F.coalesce(x, nan())


def variation(x: Column) -> Column:
    """Coefficient of variation of a group, by the population deviation."""
    return F.stddev_pop(x) / (F.avg(x) + EPS)


def exact_percentile(x: Column, p: float) -> Column:
    """Percentile with linear interpolation."""
    return F.percentile(x, F.lit(p))


def summary(x: Column, name: str) -> list[Column]:
    """Mean and the 10th and 90th percentile, NaN for nothing."""
    return [or_nan(F.avg(x)).alias(f"{name}_mean"), or_nan(exact_percentile(x, 0.1)).alias(f"{name}_L10"), or_nan(exact_percentile(x, 0.9)).alias(f"{name}_L90")]


def entropy_term(p: Column) -> Column:
    return -p * F.log(p + EPS)


def unit(x: Column, low: float = 0.0) -> Column:
    """Clipped to [low, 1]; NaN stays."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(low), F.least(x, F.lit(1.0))))


def geo_mean(*xs: Column, guard: float | None = None, plus: float | None = None) -> Column:
    """Geometric mean: 0 if an input is 0, NaN if one is negative, NaN or null.

    guard clips the inputs to [guard, 1] first, plus is added to each of them first.
    """
    xs = [or_nan(x) for x in xs]
    if guard is not None:
        xs = [unit(x, guard) for x in xs]
    if plus is not None:
        xs = [x + plus for x in xs]
    bad, zero, total = F.lit(False), F.lit(False), F.lit(0.0)
    for x in xs:
        bad, zero = bad | F.isnan(x) | (x < 0), zero | (x == 0)
        total = total + F.log(x)
    return F.when(bad, nan()).when(zero, F.lit(0.0)).otherwise(F.exp(total / len(xs)))


def falling(x: Column) -> Column:
    """1 / (1 + x)."""
    return 1.0 / (1.0 + x)


def slowly_falling(x: Column) -> Column:
    """1 / (1 + ln(1 + max(x, 0)))."""
    return F.when(F.isnan(x), x).otherwise(1.0 / (1.0 + F.log1p(F.greatest(x, F.lit(0.0)))))


def rising(x: Column, c: float = 1.0) -> Column:
    """x / (x + c)."""
    return x / (x + c + EPS)


def log_cells(cells: int) -> float:
    return math.log(cells) + EPS
