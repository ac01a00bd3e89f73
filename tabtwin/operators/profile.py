"""Profile of one table (the EDA job): single-pass aggregates, unpivots, grouping sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabtwin.session import cut_lineage
from tabtwin.operators.ordered import exact_quantiles, long_discrete, long_numeric, value_counts


def value_counts_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, count, proportion); missing is a level, proportion over all rows."""
    counts = long_discrete(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("proportion", F.col("count") / F.lit(df.count()))      # each column has a level for every row


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, count, mean, std, min, q25, q50, q75, max); quartiles exact (linear)."""
    long = long_numeric(df, columns)
    moments = long.groupBy("column_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    counts = cut_lineage(value_counts(long, ["column_name"], "value"))   # read three times below
    q = exact_quantiles(counts, ["column_name"], "value", "cnt", [0.25, 0.5, 0.75])
    quart = q.groupBy("column_name").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
        for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return moments.join(quart, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, count, percent) of missing values, only columns with any."""
    cols = columns or df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = one.unpivot(["_n"], cols, "column_name", "count")
    return long.filter(F.col("count") > 0).select(
        "column_name", "count", F.round(F.col("count") * 100.0 / F.col("_n"), 2).alias("percent"))


def _grouped_rate(df: DataFrame, value: F.Column, group_cols: list[str], rate_name: str) -> DataFrame:
    """Mean of ``value`` by each grouping column separately (grouping sets, one scan)."""
    long = df.select(value.alias("_v"), *[F.col(c).cast("string").alias(c) for c in group_cols]) \
        .unpivot(["_v"], group_cols, "group_column", "group_value")
    return (long.filter(F.col("group_value").isNotNull())
            .groupBy("group_column", "group_value")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias(rate_name)))


def group_missing_rate(df: DataFrame, column: str, group_cols: list[str]) -> DataFrame:
    """(group_column, group_value, n, missing_rate) of ``column`` by each grouping column."""
    return _grouped_rate(df, F.col(column).isNull().cast("double"), group_cols, "missing_rate")


def group_target_rate(df: DataFrame, target: str, group_cols: list[str]) -> DataFrame:
    """(group_column, group_value, n, target_rate, overall_rate)."""
    rates = _grouped_rate(df, F.col(target).cast("double"), group_cols, "target_rate")
    return rates.withColumn("overall_rate", df.agg(F.avg(F.col(target).cast("double"))).scalar())


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """positives, negatives, percent positive, imbalance ratio (negatives / positives)."""
    agg = df.agg(F.count_if(F.col(target) == 1).alias("positives"), F.count_if(F.col(target) == 0).alias("negatives"),
                 F.count(F.lit(1)).alias("n"))
    return agg.select("positives", "negatives",
                      (F.col("positives") * 100.0 / F.col("n")).alias("percent_positive"),
                      F.try_divide(F.col("negatives").cast("double"), F.col("positives")).alias("imbalance_ratio"))


def conditional_mean_shift(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(column_name, mean_positive, mean_negative, shift = positive - negative)."""
    long = long_numeric(df, columns, ids=[target])
    return long.groupBy("column_name").agg(
        F.avg(F.when(F.col(target) == 1, F.col("value"))).alias("mean_positive"),
        F.avg(F.when(F.col(target) == 0, F.col("value"))).alias("mean_negative")
    ).withColumn("shift", F.col("mean_positive") - F.col("mean_negative"))


def extremes(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c)
                   for c in columns])
    long = one.unpivot([], columns, "column_name", "mm")
    return long.select("column_name", "mm.min", "mm.max")


def histogram_table(df: DataFrame, columns: list[str], bins: int = 10, by: str | None = None) -> DataFrame:
    """(column_name, [by,] bin, lo, hi, count, density): equal-width bins on [min, max],
    left-closed except the last; density = count / (n * width) within the column (and group)."""
    ids = [by] if by else []
    long = long_numeric(df, columns, ids=ids).filter(F.col("value").isNotNull())
    rng = long.groupBy("column_name").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    # one row per column; a handful of rows
    edges = rng.select("column_name", "_lo", "_hi", F.array(*[
        F.col("_lo") + F.lit(i) * ((F.col("_hi") - F.col("_lo")) / F.lit(bins)) for i in range(bins + 1)]).alias("_e"))
    binned = long.join(F.broadcast(edges), "column_name").withColumn(
        "bin", F.least(F.lit(bins - 1), F.size(F.filter(F.slice("_e", 2, bins - 1), lambda e: e <= F.col("value")))))
    counts = binned.groupBy("column_name", *ids, "bin", "_e").agg(F.count(F.lit(1)).alias("count"))
    grp = Window.partitionBy("column_name", *ids)
    lo = F.element_at("_e", F.col("bin") + 1)
    hi = F.element_at("_e", F.col("bin") + 2)
    return counts.select("column_name", *ids, "bin", lo.alias("lo"), hi.alias("hi"), "count",
                         F.try_divide(F.col("count").cast("double"), F.sum("count").over(grp) * (hi - lo))
                         .alias("density"))


#: Values that a task holds against the grid at a time.
KDE_BLOCK = 1 << 12


def kde_table(real: DataFrame, synthetic: DataFrame, columns: list[str], grid_size: int = 200,
              cut: float = 3.0) -> DataFrame:
    """Gaussian KDE curves of each numeric column for both tables on a shared grid.

    Bandwidth per side = sample std * n^(-1/5) (Scott). The grid spans the union range
    widened by ``cut`` bandwidths. Exact: the kernel of every distinct value, times its count, at every grid
    point; tasks sum their values' kernels, ``grid_size`` sums a curve. Returns (column_name, side, grid_index, x,
    density). A column without spread has no curve.
    """
    tagged = (real.select(*columns, F.lit("real").alias("side"))
              .unionByName(synthetic.select(*columns, F.lit("synthetic").alias("side"))))
    long = long_numeric(tagged, columns, ids=["side"]).filter(F.col("value").isNotNull())
    stats = long.groupBy("column_name", "side").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    stats = stats.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).where(F.col("h") > 0)
    span = stats.groupBy("column_name").agg((F.min("lo") - F.lit(cut) * F.max("h")).alias("g0"),
                                            (F.max("hi") + F.lit(cut) * F.max("h")).alias("g1"))
    params = cut_lineage(stats.join(span, "column_name").withColumn("step", (F.col("g1") - F.col("g0")) / F.lit(grid_size - 1))
                         .select("column_name", "side", "n", "h", "g0", "step"))       # columns x 2 rows
    distinct = long.groupBy("column_name", "side", "value").agg(F.count(F.lit(1)).alias("w"))
    curves = params.collect()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(curves), grid_size))
        for batch in batches:
            value, w = (batch.column(c).to_numpy() for c in ("value", "w"))
            for i, r in enumerate(curves):
                own = pc.and_(pc.equal(batch.column("column_name"), r.column_name), pc.equal(batch.column("side"), r.side))
                at = np.flatnonzero(own.to_numpy(zero_copy_only=False))
                x = r.g0 + np.arange(grid_size) * r.step
                for s in range(0, len(at), KDE_BLOCK):
                    here = at[s:s + KDE_BLOCK]
                    z = (x[None, :] - value[here, None]) / r.h
                    sums[i] += w[here] @ np.exp(-0.5 * z * z)
        for r, s in zip(curves, sums):
            yield pa.RecordBatch.from_arrays([pa.array([r.column_name] * grid_size, pa.string()), pa.array([r.side] * grid_size, pa.string()),
                                              pa.array(np.arange(grid_size, dtype=np.int32)), pa.array(s)], names=["column_name", "side", "grid_index", "s"])

    parts = distinct.mapInArrow(run, "column_name string, side string, grid_index int, s double")
    sums = parts.groupBy("column_name", "side", "grid_index").agg(F.sum("s").alias("s"))
    return sums.join(F.broadcast(params), ["column_name", "side"]).select(
        "column_name", "side", "grid_index", (F.col("g0") + F.col("grid_index") * F.col("step")).alias("x"),
        (F.col("s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def combo_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Size of each combination of ``columns`` (rows with a missing key dropped)."""
    cond = None
    for c in columns:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.filter(cond).groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def k_anonymity_profile(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """total_combinations, unique (n=1), near_unique (n<=k), rows_in_near_unique."""
    combos = combo_counts(df, columns)
    return combos.agg(F.count(F.lit(1)).alias("total_combinations"),
                      F.count_if(F.col("count") == 1).alias("unique_combinations"),
                      F.count_if(F.col("count") <= k).alias("near_unique_combinations"),
                      F.coalesce(F.sum(F.when(F.col("count") <= k, F.col("count"))), F.lit(0))
                      .alias("rows_in_near_unique"))


def rarest_combos(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """The ``n`` smallest combinations (ties broken by the key values): a top-k report."""
    return combo_counts(df, columns).orderBy("count", *columns).limit(n)


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier identical row (missing values compare equal)."""
    cols = columns or df.columns
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Signed Pearson r of every pair a<b, pairwise complete; null when a side is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x = F.when(both, F.col(a).cast("double"))
        y = F.when(both, F.col(b).cast("double"))
        aggs += [F.var_pop(x).alias(f"vx{i}"), F.var_pop(y).alias(f"vy{i}"), F.covar_pop(x, y).alias(f"c{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, (a, b) in enumerate(pairs):
        r = F.when((F.col(f"vx{i}") > 0) & (F.col(f"vy{i}") > 0),
                   F.col(f"c{i}") / F.sqrt(F.col(f"vx{i}") * F.col(f"vy{i}")))
        rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("r")))
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.col_a", "p.col_b", "p.r")


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(key).limit(n)


def schema_info(df: DataFrame) -> DataFrame:
    """(position, column_name, non_null, dtype)."""
    one = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    types = dict(df.dtypes)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(c).alias("non_null"),
                     F.lit(types[c]).alias("dtype")) for i, c in enumerate(df.columns)]
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
