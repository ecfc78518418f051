"""Exact quantiles of groups by rank selection over counted values.

Values are counted per (group, value) first, partially in each task. Prefix sums over blocks of
``width`` values tell which blocks hold the wanted ranks; only those blocks (two for a quantile at
most) are opened, and prefix sums inside them find the values. No task holds a group's values: a
window runs over a group's blocks or over one block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1024


def rank_quantiles(counts: DataFrame, keys: Sequence[str], value: str, count: str, probs: Sequence[float],
                   width: float = WIDTH) -> DataFrame:
    """Per ``keys``: ``total`` and ``q``, an array of the interpolated quantiles ``probs``.

    ``counts`` has a row per (keys, value) with its number of occurrences; it is read twice. A null
    or not-a-number value doesn't count; groups without values are absent, and null keys are a group.
    The q-quantile of n values lies at rank q * (n - 1), linear between its two neighbours."""
    keys = list(keys)
    v, c = F.col(value).cast("double"), F.col(count)
    rows = counts.select(*keys, v.alias("_v"), c.alias("_c")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.withColumn("_block", F.floor(F.col("_v") / F.lit(float(width))))
    # where each block begins among the group's ranks
    in_order = Window.partitionBy(*keys).orderBy("_block")
    blocks = rows.groupBy(*keys, "_block").agg(F.sum("_c").alias("_n")).select(
        *keys, "_block", "_n", (F.sum("_n").over(in_order) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("total"))
    at = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    wanted = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    held = F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    opened = blocks.select(*keys, "_block", "_before", "total", held.alias("_ranks")).filter(F.size("_ranks") > 0)
    names = {k: f"_k_{i}" for i, k in enumerate(keys)}
    other = opened.withColumnsRenamed(names | {"_block": "_b"})
    on = F.col("_block") == F.col("_b")
    for k, name in names.items():
        on = on & F.col(k).eqNullSafe(F.col(name))
    inside = rows.join(other, on).drop("_b", *names.values())
    upto = Window.partitionBy(*keys, "_block").orderBy("_v")
    inside = inside.withColumn("_end", F.col("_before") + F.sum("_c").over(upto))
    here = F.filter("_ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_c")))
    found = inside.select(*keys, "total", "_v", F.explode(here).alias("_rank"))
    low, high = [], []
    for p in probs:
        x = F.lit(float(p)) * (F.col("total") - 1)
        low.append(F.max(F.when(F.col("_rank") == F.floor(x), F.col("_v"))))
        high.append(F.max(F.when(F.col("_rank") == F.ceil(x), F.col("_v"))))
    out = found.groupBy(*keys, "total").agg(F.array(*low).alias("_low"), F.array(*high).alias("_high"))
    part = F.array(*[F.lit(float(p)) * (F.col("total") - 1) for p in probs])
    q = F.transform("_low", lambda a, i: a + (F.get("_high", i) - a) * (F.get(part, i) - F.floor(F.get(part, i))))
    return out.select(*keys, "total", q.alias("q"))
