"""Central moments (count, mean, sum of squares about the mean) that are merged and subtracted.

Sums of squares lose all digits where values are large and close together; central moments don't.
``moments`` aggregates rows, ``merged`` adds up the moments of parts (the parallel-variance merge of
Chan et al.), ``without`` takes a part out of a whole again (leave-one-out down-dating). The moments
of a value ``x`` are the columns ``x_n``, ``x_mean`` and ``x_m2``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import safe_div


def moments(x: Column, name: str) -> list[Column]:
    """Aggregates of a group-by; nulls don't count. An empty group has n 0 and null mean and m2."""
    x = x.cast("double")
    return [F.count(x).alias(f"{name}_n"), F.avg(x).alias(f"{name}_mean"),
            (F.var_pop(x) * F.count(x)).alias(f"{name}_m2")]


def null_safe(df: DataFrame, other: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``other``'s row of equal ``keys``; a null key equals a null key."""
    keys = list(keys)
    other = other.withColumnsRenamed({k: f"_o_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return df.join(other, cond, how).drop(*[f"_o_{k}" for k in keys])


def merged(parts: DataFrame, keys: Iterable[str], names: Iterable[str]) -> DataFrame:
    """One row of moments per ``keys``, from the moments of ``parts``.

    Two aggregates, the means and then the squares about them, both partial in each task: a key that
    holds nearly all parts is split. ``parts`` is read twice: write it first where it is costly."""
    keys, names = list(keys), list(names)
    n, mean = (lambda x: F.col(f"{x}_n")), (lambda x: F.col(f"{x}_mean"))
    first = []
    for x in names:
        first += [F.sum(n(x)).alias(f"{x}_n"), safe_div(F.sum(n(x) * mean(x)), F.sum(n(x))).alias(f"{x}_mean")]
    totals = parts.groupBy(*keys).agg(*first)
    about = totals.select(*keys, *[mean(x).alias(f"_{x}") for x in names])
    squares = null_safe(parts, about, keys).groupBy(*keys).agg(
        *[F.sum(F.coalesce(F.col(f"{x}_m2") + n(x) * F.pow(mean(x) - F.col(f"_{x}"), 2), F.lit(0.0))).alias(f"{x}_m2")
          for x in names])
    return null_safe(totals, squares, keys)


def without(whole: tuple[Column, Column, Column], part: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """(n, mean, m2) of the rows of ``whole`` that aren't in ``part``; null where none is left."""
    (n, mean, m2), (k, k_mean, k_m2) = whole, part
    left = n - k
    rest = mean + safe_div((mean - k_mean) * k, left)
    squares = F.greatest(m2 - k_m2 - safe_div(F.pow(k_mean - rest, 2) * k * left, n), F.lit(0.0))
    return left, rest, F.when(left > 0, squares)


def var_samp(n: Column, m2: Column) -> Column:
    """Sample variance; null below two rows."""
    return F.when(n > 1, m2 / (n - 1))
