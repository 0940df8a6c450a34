"""Exact one-sided 2x2 enrichment test as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_LARGEST_EXACT = 20  # factorial(20) is the last one a long can hold


def log_factorial(n: Column) -> Column:
    """ln(n!): exact product up to 20, Stirling's series beyond (relative error below 1e-15)."""
    x = n.cast("double")
    series = (
        x * F.log(x)
        - x
        + F.lit(0.5) * F.log(F.lit(2 * math.pi) * x)
        + F.lit(1.0) / (F.lit(12.0) * x)
        - F.lit(1.0) / (F.lit(360.0) * F.pow(x, F.lit(3.0)))
        + F.lit(1.0) / (F.lit(1260.0) * F.pow(x, F.lit(5.0)))
        - F.lit(1.0) / (F.lit(1680.0) * F.pow(x, F.lit(7.0)))
    )
    small = F.log(F.factorial(F.least(n, F.lit(_LARGEST_EXACT)).cast("int")).cast("double"))
    return F.when(n <= _LARGEST_EXACT, small).otherwise(series)


def fisher_greater(pos: Column, neg: Column, n_pos: Column, n_neg: Column) -> Column:
    """P(X >= pos) for X hypergeometric: Fisher's exact test, alternative "greater".

    ``pos`` of ``n_pos`` positive and ``neg`` of ``n_neg`` negative samples carry the feature. All terms are taken
    relative to that of ``pos``, by the exact ratio of neighbours, so no factorial is needed and nothing cancels:
    with ``upper`` the sum from ``pos`` on and ``lower`` the sum below it, the result is upper / (upper + lower).

    Away from the mode the ratio itself falls by a factor of at least exp(-1 / width^2) a step, so terms more than
    10 widths beyond the mean and ``pos`` add less than exp(-50) of the largest and are left out; a ``pos`` more than
    40 widths off the mean has a probability below exp(-800), or above one less that, which no double tells from 0 and 1.
    The sums are thus as long as the width, at most the square root of the samples, not as long as the tail.
    """
    carriers = pos + neg
    total = n_pos + n_neg
    lowest = F.greatest(F.lit(0).cast("long"), carriers - n_neg)
    highest = F.least(n_pos, carriers)
    mean = carriers.cast("double") * n_pos.cast("double") / total.cast("double")

    # 1/(n_pos-x) + 1/(x+1) + 1/(carriers-x) + 1/(n_neg-carriers+x+1) is the fall of the log ratio; two ways to pair
    # its parts give two lower bounds that hold for every x
    def bound(n: Column, m: Column) -> Column:
        return F.lit(4.0) / (n + 1).cast("double") + F.lit(4.0) / (m + 1).cast("double")

    width = F.lit(1.0) / F.sqrt(F.greatest(bound(n_pos, n_neg), bound(carriers, total - carriers)))
    off = pos.cast("double") - mean
    reach = F.lit(10.0) * width + 3

    def ratio_up(x: Column) -> Column:
        """Term x + 1 over term x."""
        up = (n_pos - x).cast("double") * (carriers - x).cast("double")
        return up / ((x + 1).cast("double") * (n_neg - carriers + x + 1).cast("double"))

    def ratio_down(x: Column) -> Column:
        """Term x - 1 over term x."""
        down = x.cast("double") * (n_neg - carriers + x).cast("double")
        return down / ((n_pos - x + 1).cast("double") * (carriers - x + 1).cast("double"))

    def beyond(steps: Column, ratio, direction: int) -> Column:
        """Sum of the ``steps`` terms after that of ``pos``, which is one."""
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))

        def step(acc: Column, i: Column) -> Column:
            term = acc["term"] * ratio(pos + F.lit(direction) * i)
            return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

        summed = F.aggregate(F.sequence(F.lit(0).cast("long"), steps - 1), zero, step, lambda acc: acc["sum"])
        return F.when(steps > 0, summed).otherwise(F.lit(0.0))

    def steps(room: Column, past_mean: Column) -> Column:
        return F.least(room, F.ceil(reach + F.greatest(F.lit(0.0), past_mean)))

    upper = F.lit(1.0) + beyond(steps(highest - pos, -off), ratio_up, 1)
    lower = beyond(steps(pos - lowest, off), ratio_down, -1)
    return (
        F.when(pos <= lowest, F.lit(1.0))
        .when(off > F.lit(40.0) * width + 3, F.lit(0.0))
        .when(off < F.lit(-40.0) * width - 3, F.lit(1.0))
        .otherwise(F.lit(1.0) / (F.lit(1.0) + lower / upper))
    )
