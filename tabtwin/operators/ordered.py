"""Order-dependent aggregates without a single-task global window.

``Window.orderBy`` with no partition (or a partition per metric column) sends every
row of that partition to one task. These helpers split the order domain into
range buckets from a mergeable quantile sketch, compute exact running totals inside
each bucket in parallel, and add the exact totals of all earlier buckets, taken from a
small (groups x buckets) table. The result is exact and does not depend on how the
buckets fall; buckets only spread the work.

- ``prefix_sums``: running sums of some columns in value order, per group.
- ``exact_quantiles``: linear-interpolated quantiles (``quantile_cont`` / numpy
  ``linear``) from a (group, value, count) table, located by running counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least number of buckets per group; sessions set up for more shuffle partitions get more.
LEAST_BUCKETS = 64


def default_buckets(df: DataFrame) -> int:
    """Two buckets for each shuffle partition, the number that a session sets for its data's size."""
    return max(LEAST_BUCKETS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def null_safe_join(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``columns`` in which null equals null; the left's key columns stay."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in columns], *[c for c in right.columns if c not in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in columns])


def below(bounds: Column, value: Column, most: int) -> Column:
    """How many of the ascending ``bounds`` (``most`` at most) are less than ``value``: a binary search, null for a null value."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most).bit_length()))])
    further = lambda at, step: F.when((at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) < value), at + step).otherwise(at)
    return F.when(value.isNotNull(), F.aggregate(steps, F.lit(0), further))


def prefix_sums(df: DataFrame, group_cols: list[str], order_col: str, sum_cols: list[str],
                buckets: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over rows of the same group with order value <= this row's.

    Rows with a null order value get null running sums; the rows of a null group are a group.
    """
    group_cols = list(group_cols)
    buckets = buckets or default_buckets(df)
    if not group_cols:
        return prefix_sums(df.withColumn("_g", F.lit(0)), ["_g"], order_col, sum_cols, buckets, prefix).drop("_g")
    probs = [i / buckets for i in range(1, buckets)]
    bounds = (df.filter(F.col(order_col).isNotNull())
              .groupBy(*group_cols)
              .agg(F.percentile_approx(F.col(order_col), probs, 10000).alias("_bounds")))
    # one row of <= buckets-1 bounds per group; Spark broadcasts them if their size allows
    bounded = null_safe_join(df, bounds, group_cols, "left")
    bounded = bounded.withColumn("_bucket", below(F.col("_bounds"), F.col(order_col), buckets)).drop("_bounds")

    totals = bounded.groupBy(*group_cols, "_bucket").agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    before = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, "_bucket",
                            *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}")
                              for c in sum_cols])

    within = (Window.partitionBy(*group_cols, "_bucket").orderBy(order_col)
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = null_safe_join(bounded, offsets, group_cols + ["_bucket"], "left")
    for c in sum_cols:
        out = out.withColumn(f"{prefix}{c}", F.when(F.col(order_col).isNotNull(),
                                                     F.col(f"_off_{c}") + F.sum(c).over(within)))
    return out.drop("_bucket", *[f"_off_{c}" for c in sum_cols])


def range_sums(df: DataFrame, group_cols: list[str], order_col: str, sum_col: str, name: str) -> DataFrame:
    """``df`` (a row per group and value) with ``name``: the sum of ``sum_col`` over the values of the group before this one.

    Works for values of any order, texts too; a null value comes first. Rows are range-partitioned by group and value, summed
    within their partition, and shifted by the partitions before (a row for each partition that a group reaches into).
    """
    from tabtwin.session import cut_lineage
    keys = [*[F.col(c) for c in group_cols], F.col(order_col).asc_nulls_first()]
    dealt = cut_lineage(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))     # the numbers must not change below
    sizes = dealt.groupBy(*group_cols, "_part").agg(F.sum(sum_col).alias("_size"))
    earlier = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group_cols, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*group_cols, "_part").orderBy(F.col(order_col).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = null_safe_join(dealt, offsets, [*group_cols, "_part"])
    return placed.withColumn(name, F.col("_off") + F.coalesce(F.sum(sum_col).over(within), F.lit(0))).drop("_part", "_off")


def exact_quantiles(counts: DataFrame, group_cols: list[str], value_col: str, count_col: str,
                    probs: list[float], buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group.

    ``counts`` has one row per (group, value) with a positive ``count_col``; null values
    must be removed beforehand. Returns (group..., prob, quantile); position
    h = (n-1)p, quantile = x[floor h] + (h - floor h)(x[ceil h] - x[floor h]).
    """
    group_cols = list(group_cols)
    cum = prefix_sums(counts, group_cols, value_col, [count_col], buckets=buckets)
    cum = cum.withColumn("_prev", F.col(f"cum_{count_col}") - F.col(count_col))
    sizes = counts.groupBy(*group_cols).agg(F.sum(count_col).alias("_n"))
    probes = (sizes.select(*group_cols, "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
              .withColumn("_h", (F.col("_n") - 1).cast("double") * F.col("prob"))
              .withColumn("_lo", F.floor("_h").cast("bigint"))
              .withColumn("_hi", F.ceil("_h").cast("bigint")))
    positions = probes.select(*group_cols, "prob", "_h", "_lo",
                              F.explode(F.array(F.struct(F.lit("lo").alias("role"), F.col("_lo").alias("k")),
                                                F.struct(F.lit("hi").alias("role"), F.col("_hi").alias("k"))))
                              .alias("_pos")).select(*group_cols, "prob", "_h", "_lo", "_pos.role", "_pos.k")
    # probes are (groups x probs x 2) rows; equi-join on the group, then the rank interval
    joined = null_safe_join(cum, positions, group_cols) \
        .filter((F.col("_prev") <= F.col("k")) & (F.col("k") < F.col(f"cum_{count_col}")))
    picked = joined.groupBy(*group_cols, "prob", "_h", "_lo").agg(
        F.max(F.when(F.col("role") == "lo", F.col(value_col))).alias("_vlo"),
        F.max(F.when(F.col("role") == "hi", F.col(value_col))).alias("_vhi"))
    frac = F.col("_h") - F.col("_lo").cast("double")
    quantile = F.when(frac == 0, F.col("_vlo")).otherwise(
        F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac)
    return picked.select(*group_cols, "prob", quantile.cast("double").alias("quantile"))


def value_counts(df: DataFrame, group_cols: list[str], value_col: str, count_name: str = "cnt") -> DataFrame:
    """(group, value, count) of non-null values: the input of ``exact_quantiles``."""
    return (df.filter(F.col(value_col).isNotNull())
            .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias(count_name)))


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median of each numeric column: (column, median)."""
    from tabtwin.session import cut_lineage
    long = long_numeric(df, columns)
    counts = cut_lineage(value_counts(long, ["column_name"], "value"))   # read three times below
    q = exact_quantiles(counts, ["column_name"], "value", "cnt", [0.5])
    return q.select("column_name", F.col("quantile").alias("median"))


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mode) of the discrete columns: the most frequent value as text, the smallest of equally frequent ones."""
    counts = value_counts(long_discrete(df, columns), ["column_name"], "value")
    first = F.struct((-F.col("cnt")).alias("n"), F.expr("try_cast(value AS double)").alias("number"), F.col("value"))
    return counts.groupBy("column_name").agg(F.min_by("value", first).alias("mode"))


def long_numeric(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """Unpivot numeric columns to (ids..., column, value double)."""
    ids = list(ids or [])
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(ids, list(columns), "column_name", "value")


def long_discrete(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """Unpivot discrete columns to (ids..., column, value string); null stays null."""
    ids = list(ids or [])
    cast = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns])
    return cast.unpivot(ids, list(columns), "column_name", "value")
