"""Exact percentiles over groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one buffer of one task.
Here the work is spread: equal values are counted first, then counted per coarse bin, and only
the bins holding a wanted rank are looked at value by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bins per factor e. The bin grows with the logarithm of the value, so a group has at most
# 44 * BINS_PER_E bins over the whole bigint range and a bin is about value / BINS_PER_E wide.
BINS_PER_E = 1024
NULL_BIN = -1
# The group of a query without groups.
ALL = "_all"


def bin_of(value: Column) -> Column:
    # Never NULL, so that the join on it adds no filter that would keep the counts from being shared.
    return F.coalesce(F.floor(F.log1p(value.cast("double")) * F.lit(float(BINS_PER_E))).cast("int"), F.lit(0))


def _rank(p: float, total: Column) -> Column:
    return F.lit(float(p)) * (total - 1).cast("double")


def _all(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def exact_percentiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    names: dict[str, float],
    count_name: str | None = None,
    mean_name: str | None = None,
    null_name: str | None = None,
) -> DataFrame:
    """Linear-interpolated percentiles of a non-negative bigint column.

    One row per group with a column per entry of ``names`` (name -> p), plus the number of
    values and their mean when ``count_name`` or ``mean_name`` is given. NULL values are ignored;
    ``null_name`` counts them on the way, and groups that hold nothing else have a row then.
    Without groups there is always one row; it holds NULLs and a count of 0 when no value exists.
    """
    groups = list(groups)
    src = df if null_name else df.filter(F.col(value).isNotNull())
    keys = groups or [ALL]
    if not groups:
        src = src.withColumn(ALL, F.lit(0))

    hist = (
        src.groupBy(*keys, F.col(value).cast("bigint").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin", F.when(F.col("_v").isNull(), NULL_BIN).otherwise(bin_of(F.col("_v"))) if null_name else bin_of(F.col("_v")))
    )
    bins = hist.groupBy(*keys, "_bin").agg(
        F.sum("_n").alias("_bn"), F.sum(F.col("_v").cast("double") * F.col("_n")).alias("_bs")
    )
    picked = pick_bins(bins, keys, names, null_name is not None)
    return percentiles_in(hist, picked, groups, names, count_name, mean_name, null_name)


def pick_bins(bins: DataFrame, keys: Sequence[str], names: dict[str, float], nulls: bool = False) -> DataFrame:
    """The bins that hold a wanted rank, of (keys, _bin, _bn values, _bs their sum), with where they start."""
    by_group = Window.partitionBy(*keys)
    running = by_group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if nulls:
        null = F.col("_bin") == NULL_BIN
        bins = bins.withColumn("_nulls", F.sum(F.when(null, F.col("_bn")).otherwise(0)).over(by_group))
        bins = bins.withColumn("_bn", F.when(null, 0).otherwise(F.col("_bn")))
    bins = (
        bins.withColumn("_end", F.sum("_bn").over(running))
        .withColumn("_total", F.sum("_bn").over(by_group))
        .withColumn("_mean", F.sum("_bs").over(by_group) / F.col("_total"))
    )
    wanted = F.array(
        *[f(_rank(p, F.col("_total"))) for p in names.values() for f in (F.floor, F.ceil)]
    )
    holds_rank = F.exists(wanted, lambda r: (r >= F.col("_start")) & (r < F.col("_end")))
    picked = bins.withColumn("_start", F.col("_end") - F.col("_bn")).filter(
        (holds_rank | (F.col("_bin") == NULL_BIN)) if nulls else holds_rank
    )
    return picked.select(*keys, "_bin", "_start", "_total", "_mean", *(["_nulls"] if nulls else []))


def percentiles_in(
    hist: DataFrame,
    picked: DataFrame,
    groups: Sequence[str],
    names: dict[str, float],
    count_name: str | None = None,
    mean_name: str | None = None,
    null_name: str | None = None,
) -> DataFrame:
    """Percentiles from value counts (keys, _v, _n, _bin), of which only those in the picked bins are looked at."""
    keys = list(groups) or [ALL]
    sums = ["_start", "_total", "_mean"] + (["_nulls"] if null_name else [])
    inside = (
        Window.partitionBy(*keys, "_bin")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    fine = (
        hist.join(picked.select(*keys, "_bin", *sums), [*keys, "_bin"])
        .withColumn("_hi", F.col("_start") + F.sum("_n").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
    )

    aggs = [F.max(c).alias(c) for c in sums[1:]]
    for i, p in enumerate(names.values()):
        pos = _rank(p, F.col("_total"))
        for tag, f in (("l", F.floor), ("h", F.ceil)):
            r = f(pos)
            holds = (F.col("_lo") <= r) & (r < F.col("_hi"))
            aggs.append(F.max(F.when(holds, F.col("_v"))).cast("double").alias(f"_{tag}{i}"))
    out = (fine.groupBy(*groups) if groups else fine).agg(*aggs)

    cols = [F.col(g) for g in groups]
    for i, (name, p) in enumerate(names.items()):
        pos = _rank(p, F.col("_total"))
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        cols.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    if count_name:
        cols.append(F.coalesce("_total", F.lit(0)).cast("bigint").alias(count_name))
    if mean_name:
        cols.append(F.col("_mean").alias(mean_name))
    if null_name:
        cols.append(F.coalesce("_nulls", F.lit(0)).cast("bigint").alias(null_name))
    return out.select(*cols)


def approx_percentiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    names: dict[str, float],
    count_name: str | None = None,
    mean_name: str | None = None,
    accuracy: int = 10000,
) -> DataFrame:
    """The same result shape from one mergeable summary per group: one shuffle, bounded memory."""
    ps = [float(p) for p in names.values()]
    aggs = [F.percentile_approx(F.col(value).cast("double"), ps, accuracy).alias("_q")]
    if count_name:
        aggs.append(F.count(value).alias(count_name))
    if mean_name:
        aggs.append(F.avg(value).alias(mean_name))
    src = df.filter(F.col(value).isNotNull())
    out = (src.groupBy(*groups) if groups else src).agg(*aggs)
    cols = [F.col(g) for g in groups] + [F.col("_q")[i].alias(n) for i, n in enumerate(names)]
    return out.select(*cols, *[n for n in (count_name, mean_name) if n])
