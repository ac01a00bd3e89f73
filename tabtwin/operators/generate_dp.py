"""Differentially private generator from noisy low-order marginals.

1. Discretise numeric columns on public bounds (10 equal-width bins); every column
   becomes a code string, missing -> ``NA`` (only in the domain of declared nullable
   columns).
2. Marginals follow the public visit order: column 0 alone, column 1 with column 0, and
   every later column with its two predecessors (highest order 3). Each is counted with
   one group-by, left-joined *from the full public domain* so empty cells get noise too.
3. Laplace noise of scale 2m/epsilon on every cell (m marginals share epsilon; with the
   row count public, neighbours replace one row, L1 sensitivity 2); negatives -> 0.
4. n rows are sampled column by column: the child is drawn from the noisy counts of its
   parents' cell (an equi-join on the parent codes, then a position in the cumulative
   weights); a cell with zero weight falls back to the child's noisy 1-way counts
   (post-processing, no extra budget).
5. Codes -> interval midpoints, types and column order of the input restored.

Epsilon is a key of every table (``eps``, its text): a sweep is one count, one noise table, one set of
conditional tables and one sampling chain over (epsilon, row). Noise uniforms are hash draws of (noise_seed, marginal, cell). ``noise_seed=None`` (the
default) draws a secret seed from the OS, as a release must; tests pass a fixed one.
"""

from __future__ import annotations

import secrets as _secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtwin.functions.hashing import hash_uniform, laplace_from_uniform
from tabtwin.operators.transform import MISSING_CODE, discretise, restore_types, undiscretise
from tabtwin.session import cut_lineage
from tabtwin.spec import ColumnSpec, DPSpec

#: Cells of a marginal, over all epsilons, that are broadcast to the rows to be drawn.
CELLS = 1 << 17


def code_domain(spec: ColumnSpec, dp: DPSpec, column: str) -> list[str]:
    if column in spec.numeric:
        codes = [str(i) for i in range(dp.bins)]
    else:
        if column not in dp.domains:
            raise ValueError(f"discrete column '{column}' needs a declared public domain")
        codes = [str(v) for v in dp.domains[column]]
    if column in dp.nullable:
        codes.append(MISSING_CODE)
    return codes


def marginal_plan(order: list[str]) -> list[tuple[str, ...]]:
    """(parents..., child) per column of the visit order, at most two parents."""
    return [tuple(order[max(0, k - 2):k + 1]) for k in range(len(order))]


def coded_rows(real: DataFrame, spec: ColumnSpec, dp: DPSpec) -> DataFrame:
    """``real`` as codes; numbers beyond the public bounds count in the end bins."""
    def clipped(c: str) -> Column:
        low, high = (F.lit(float(x)) for x in dp.bounds[c])
        x = F.col(c).cast("double")
        # least and greatest skip nulls, but a missing number must stay missing
        return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(low, F.least(high, x)))

    kept = real.select(*[clipped(c).alias(c) if c in dp.bounds else F.col(c) for c in spec.all_columns])
    return discretise(kept, dp.bounds, dp.bins, columns=spec.all_columns)


def marginal_counts(coded: DataFrame, spec: ColumnSpec, dp: DPSpec) -> DataFrame:
    """(mid, cell array<string>, n) for every marginal over its full public domain.

    The rows are read once; codes outside the domain (each column is the last one of a marginal) raise, with counts.
    """
    spark = coded.sparkSession
    plan = marginal_plan(list(dp.visit_order))
    # true counts of every marginal in one shuffle: explode (marginal id, cell) per row
    items = [F.struct(F.lit(i).alias("mid"), F.array(*[F.col(c) for c in cols]).alias("cell"))
             for i, cols in enumerate(plan)]
    counts = cut_lineage(coded.select(F.explode(F.array(*items)).alias("e")).select("e.*")
                         .groupBy("mid", "cell").agg(F.count(F.lit(1)).alias("n")))
    last = F.element_at("cell", -1)
    outside = counts.agg(*[F.sum(F.when((F.col("mid") == i) & ~last.isin(code_domain(spec, dp, cols[-1])), F.col("n"))).alias(cols[-1])
                           for i, cols in enumerate(plan)]).first().asDict()
    if wrong := {c: n for c, n in outside.items() if n}:
        raise ValueError("values outside the public domain: " + ", ".join(f"{n} in {c}" for c, n in wrong.items()))
    # the public domain: the product of the declared code sets, made by the executors
    domain = None
    for i, cols in enumerate(plan):
        cells = spark.range(1).select(F.lit(i).alias("mid"))
        for c in cols:
            cells = cells.withColumn(f"c_{c}", F.explode(F.lit(code_domain(spec, dp, c))))
        cells = cells.select("mid", F.array(*[F.col(f"c_{c}") for c in cols]).alias("cell"))
        domain = cells if domain is None else domain.union(cells)
    return domain.join(counts, ["mid", "cell"], "left").fillna(0, ["n"])


def with_noise(counts: DataFrame, dp: DPSpec, epsilons: list[float], noise_seed) -> DataFrame:
    """(eps, mid, cell, noisy double): Laplace noise of each epsilon on every cell of ``marginal_counts``."""
    each = F.array(*[F.struct(F.lit(repr(e)).alias("eps"), F.lit(2.0 * len(dp.visit_order) / e).alias("scale")) for e in epsilons])
    rows = counts.select("mid", "cell", "n", F.explode(each).alias("e")).select("e.*", "mid", "cell", "n")
    u = hash_uniform(noise_seed, F.concat(F.lit("dp:"), F.col("eps")), "mid", F.concat_ws("\u0001", "cell"))
    noisy = F.greatest(F.lit(0.0), F.col("n").cast("double") + laplace_from_uniform(u, F.col("scale")))
    return rows.select("eps", "mid", "cell", noisy.alias("noisy"))


def noisy_marginals(coded: DataFrame, spec: ColumnSpec, dp: DPSpec, epsilon: float, noise_seed) -> DataFrame:
    """(mid, cell array<string>, noisy double) for every marginal over its full public domain."""
    return with_noise(marginal_counts(coded, spec, dp), dp, [float(epsilon)], noise_seed).drop("eps")


def _weights(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., table): the values and running weights of (keys..., value, noisy) rows, in order of the values."""
    agg = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("value", "noisy"))).alias("vw"))    # one column's public domain
    # running weights by aggregate over the (small, fixed-size) weight array
    cum = F.expr("transform(w, (x, i) -> aggregate(slice(w, 1, i + 1), cast(0.0 as double), (a, b) -> a + b))")
    agg = agg.select(*keys, F.transform("vw", lambda s: s["value"]).alias("values"), F.transform("vw", lambda s: s["noisy"]).alias("w"))
    return agg.select(*keys, F.struct(F.col("values"), cum.alias("cum")).alias("table"))


def _pick(table: Column, u: Column) -> Column:
    """The value of ``table`` at ``u``. The table and the draw are bound as elements, so that neither is computed again for each weight."""
    def at(t: Column) -> Column:
        return F.transform(F.array(u * F.element_at(t["cum"], -1)), lambda k: F.element_at(
            t["values"], F.least(F.size(F.filter(t["cum"], lambda c: c <= k)) + 1, F.size(t["values"]))))

    return F.get(F.flatten(F.transform(F.array(table), at)), F.lit(0))


def _sampled(noisy: DataFrame, plan: list[tuple[str, ...]], epsilons: list[float], n: int, seed) -> DataFrame:
    """(eps, id, code columns): ``n`` rows for each epsilon."""
    sizes = {r["mid"]: r["count"] for r in noisy.groupBy("mid").count().collect()}         # cells of each marginal
    out = noisy.sparkSession.range(n).select(F.explode(F.array(*[F.lit(repr(e)) for e in epsilons])).alias("eps"), "id")
    for i, cols in enumerate(plan):
        child, parents = cols[-1], list(cols[:-1])
        cells = noisy.where(F.col("mid") == i).select("eps", *[F.col("cell")[j].alias(p) for j, p in enumerate(parents)],
                                                      F.element_at("cell", -1).alias("value"), "noisy")
        # Both tables have a row per epsilon and cell of the parents' public domain at most; the rows stay where they are.
        given = _weights(cells, ["eps", *parents]).withColumnRenamed("table", "_given")
        alone = _weights(cells.groupBy("eps", "value").agg(F.sum("noisy").alias("noisy")), ["eps"]).withColumnRenamed("table", "_alone")
        given = F.broadcast(given) if sizes.get(i, 0) <= CELLS else given
        step = out.join(given, ["eps", *parents], "left").join(F.broadcast(alone), "eps", "left")
        u = hash_uniform(seed, F.concat(F.lit("dp-sample:"), F.col("eps"), F.lit(f":{child}")), "id")
        value = _pick(F.when(F.element_at("_given.cum", -1) > 0, F.col("_given")).otherwise(F.col("_alone")), u)
        out = step.withColumn(child, value).drop("_given", "_alone")
        if (i + 1) % 4 == 0:
            out = cut_lineage(out)      # two joins per column: keep the plan short
    return out


def dp_sweep(real: DataFrame, spec: ColumnSpec, dp: DPSpec, epsilons, seed, noise_seed=None,
             key: str | None = None, n: int | None = None) -> DataFrame:
    """One synthetic table per epsilon, with an ``epsilon`` column (write with ``partitionBy("epsilon")``); columns, order and
    types of ``real`` else (``key``, if given, becomes a fresh 0..n-1 id). Each epsilon is a separate release with its own budget."""
    from tabtwin.operators.contract import validate_columns

    epsilons = [float(e) for e in epsilons]
    for e in epsilons:
        if e <= 0:
            raise ValueError(f"epsilon must be strictly positive, got {e}.")
    validate_columns(real, spec, ignore=(key,) if key else ())
    missing_bounds = [c for c in spec.numeric if c not in dp.bounds]
    if missing_bounds:
        raise ValueError(f"numeric columns without public bounds: {missing_bounds}")
    if sorted(dp.visit_order) != sorted(spec.all_columns):
        raise ValueError("visit_order must be a permutation of the declared columns")
    if noise_seed is None:
        noise_seed = _secrets.randbits(62)
    counts = marginal_counts(coded_rows(real, spec, dp), spec, dp)
    if n is None:                                  # the row count is public; every row is in a cell of the first marginal
        n = counts.where(F.col("mid") == 0).agg(F.sum("n")).first()[0]
    noisy = cut_lineage(with_noise(counts, dp, epsilons, noise_seed))   # small: sum of domain sizes
    codes = _sampled(noisy, marginal_plan(list(dp.visit_order)), epsilons, n, seed)
    kept = codes.select(*spec.all_columns, F.col("id").cast("string").alias("__id"), F.col("eps").alias("__eps"))
    decoded = undiscretise(kept, dp.bounds, dp.bins)
    fields = [f for f in real.schema.fields if f.name in spec.all_columns]
    if key:
        decoded = decoded.withColumnRenamed("__id", key)
        fields.append(real.schema[key])
    typed = restore_types(decoded, T.StructType([*fields, T.StructField("__eps", T.DoubleType())]))
    return typed.select(*[c for c in real.columns if c in spec.all_columns or c == key], F.col("__eps").alias("epsilon"))


def generate_dp(real: DataFrame, spec: ColumnSpec, dp: DPSpec, epsilon: float, seed, noise_seed=None,
                key: str | None = None, n: int | None = None) -> DataFrame:
    """``dp_sweep`` of one epsilon, without its column."""
    return dp_sweep(real, spec, dp, [epsilon], seed, noise_seed, key, n).drop("epsilon")
