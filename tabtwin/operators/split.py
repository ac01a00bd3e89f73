"""Splits and sampling, all keyed by a portable row hash (independent of partitioning).

``hash_rank`` gives every row its exact 1-based position in (hash, key) order within its
stratum. A binary stratum holds most rows in one group, so the rank is computed in two
phases: rows are spread over 2^16 hash-range buckets per stratum, ranked inside each
bucket in parallel, and shifted by the exact row count of all earlier buckets (a small
strata x buckets table). Hash order is bucket order, so the rank is the global one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtwin.functions.hashing import hash_uniform
from tabtwin.session import cut_lineage
from tabtwin.spec import SplitSpec

RANK_BUCKETS = 1 << 16
#: Strata whose cuts are broadcast; more are joined as Spark sees fit.
STRATA = 1 << 14


def hash_rank(df: DataFrame, seed, tag: str, key: str, strata: list[str] | None = None,
              buckets: int = RANK_BUCKETS) -> DataFrame:
    """Add ``_u`` (hash uniform), ``_rank`` (1-based within stratum) and ``_n`` (stratum size)."""
    strata = list(strata or [])
    skey = strata or ["_all"]
    base = df if strata else df.withColumn("_all", F.lit(0))
    base = base.withColumn("_u", hash_uniform(seed, tag, key)) \
        .withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
    sizes = base.groupBy(*skey, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    before = Window.partitionBy(*skey).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*skey)
    offsets = sizes.select(*skey, "_b", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"),
                           F.sum("_bn").over(whole).alias("_n"))
    within = Window.partitionBy(*skey, "_b").orderBy("_u", key)
    # null-safe: the rows of a null stratum are ranked among themselves
    keyed = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in skey], F.col("_b").alias("_ob"), "_off", "_n")
    same = F.col("_b") == F.col("_ob")
    for c in skey:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    ranked = (base.join(keyed, same, "left")
              .withColumn("_rank", F.col("_off") + F.row_number().over(within)))
    return ranked.select(*df.columns, "_u", "_rank", "_n")        # input column order kept


def hash_parts(df: DataFrame, seed, tag: str, key: str, stratum: str, names: list[str],
               ends: Callable[[Column], list[Column]]) -> DataFrame:
    """Add ``split``: in hash order within its stratum, the rows up to each of ``ends`` (of the stratum's size) get the
    next of ``names``, the others the last: the rows that ``hash_rank`` would give those ranks.

    Only rows of the bucket in which a part ends are ranked, once; buckets before and after belong to one part as a
    whole, so that the table isn't shuffled.
    """
    base = df.withColumn("_u", hash_uniform(seed, tag, key)).withColumn("_b", F.floor(F.col("_u") * RANK_BUCKETS).cast("int"))
    sizes = base.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    whole = Window.partitionBy(stratum)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(stratum).alias("_o"), "_b", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"), F.sum("_bn").over(whole).alias("_n"))
    last = {f"_c{i}": F.coalesce(F.max(F.when(F.col("_off") < end, F.struct("_b", (end - F.col("_off")).alias("rest")))), F.struct(F.lit(-1).alias("_b"), F.lit(0).cast("bigint").alias("rest")))
            for i, end in enumerate(e.cast("bigint") for e in ends(F.col("_n").cast("double")))}
    cuts = cut_lineage(offsets.groupBy("_o").agg(*[c.alias(name) for name, c in last.items()]))          # a row per stratum
    few = F.broadcast(cuts) if cuts.count() <= STRATA else cuts
    placed = base.join(few, F.col(stratum).eqNullSafe(F.col("_o")), "left")
    cut = F.lit(False)
    for c in last:
        cut = cut | (F.col("_b") == F.col(f"{c}._b"))

    def named(rows: DataFrame, rank: Column) -> DataFrame:
        label, rows, rank = F.lit(names[-1]), rows.withColumn("_rank", rank), F.col("_rank")
        for c, name in reversed(list(zip(last, names))):
            label = F.when((F.col("_b") < F.col(f"{c}._b")) | ((F.col("_b") == F.col(f"{c}._b")) & (rank <= F.col(f"{c}.rest"))), name).otherwise(label)
        return rows.select(*df.columns, label.alias("split"))

    within = Window.partitionBy(stratum, "_b").orderBy("_u", key)
    ranked = cut_lineage(named(placed.where(cut), F.row_number().over(within)))
    return named(placed.where(~cut), F.lit(0)).unionByName(ranked)


def stratified_split(df: DataFrame, spec: SplitSpec, seed, key: str = "rid",
                     allow_null_strata: bool = False) -> DataFrame:
    """Add ``split`` in {train, test, val}: per stratum the first floor(n*train) rows in hash
    order are train, then floor(n*test) test (or the rest when there is no val), rest val.
    Rows with a null stratum raise, with their count; ``allow_null_strata`` makes them a
    stratum of their own instead.
    """
    strat = spec.stratify_col
    if not allow_null_strata:
        nulls = df.filter(F.col(strat).isNull()).count()
        if nulls:
            raise ValueError(f"{nulls} rows have no value in the stratum column {strat!r}; fill or remove them, or allow null strata")
    train, names = float(spec.train_size), ["train", "test"] if spec.val_size is None else ["train", "test", "val"]

    def ends(n: Column) -> list[Column]:
        first = F.floor(n * F.lit(train))
        return [first] if spec.val_size is None else [first, first + F.floor(n * F.lit(float(spec.test_size)))]

    return hash_parts(df, seed, "split", key, strat, names, ends)


def validate_split(labelled: DataFrame, spec: SplitSpec) -> None:
    """Raise if a stratum is missing from a split or a split's target rate is off."""
    from tabtwin.operators.contract import empty_partition_check, strat_rate_check

    shares = {name: size for name, size in (("train", spec.train_size), ("test", spec.test_size), ("val", spec.val_size)) if size is not None}
    missing = empty_partition_check(labelled, spec.stratify_col, splits=tuple(shares)).orderBy("stratum", "split").first()
    if missing is not None:
        raise ValueError(f"stratum {missing['stratum']!r} has {missing['n']} rows, too few for a {missing['split']} share of "
                         f"{shares[missing['split']]:g}: the split {missing['split']!r} would get 0 of them")
    off = strat_rate_check(labelled, spec.stratify_col, tolerance=spec.tolerance).filter("NOT ok").orderBy("split").first()
    if off is not None:
        raise ValueError(f"split {off['split']!r} has a target rate of {off['rate']:.4f} where the whole table has "
                         f"{off['overall_rate']:.4f}; that is beyond the tolerance of {spec.tolerance:g}")


def seeded_shuffle(df: DataFrame, seed, key: str = "rid") -> DataFrame:
    """Rows in a seeded random order (only meaningful right before an ordered sink)."""
    return df.orderBy(hash_uniform(seed, "shuffle", key), key)


def stratified_holdout(df: DataFrame, label: str, seed, key: str = "rid", test_size: float = 0.3) -> DataFrame:
    """70/30 (default) stratified on ``label``: adds ``split`` in {train, test}."""
    spec = SplitSpec(train_size=1.0 - test_size, test_size=test_size, stratify_col=label)
    return hash_parts(df, seed, "holdout", key, label, ["train", "test"], lambda n: [F.floor(n * F.lit(float(spec.train_size)))])


def indexed(df: DataFrame, seed, tag: str, key: str) -> DataFrame:
    """Dense 0-based ``_idx`` in hash order and the table size ``_m`` (for donor joins)."""
    ranked = hash_rank(df, seed, tag, key)
    return ranked.withColumn("_idx", F.col("_rank") - 1).withColumnRenamed("_n", "_m").drop("_u", "_rank")


def bootstrap_sample(df: DataFrame, n: int, seed, key: str = "rid", tag: str = "bootstrap") -> DataFrame:
    """Exactly ``n`` draws with replacement: draw i takes donor floor(u_i * m). Adds ``draw_id``."""
    spark = df.sparkSession
    donors = indexed(df, seed, f"{tag}#order", key)
    m = donors.agg(F.count(F.lit(1)).alias("m"))
    draws = spark.range(n).withColumnRenamed("id", "draw_id").withColumn("m", m.scalar())
    draws = draws.withColumn("_idx", F.floor(hash_uniform(seed, tag, "draw_id") * F.col("m")).cast("bigint"))
    return draws.join(donors.drop("_m"), "_idx").drop("_idx", "m")


def attack_target_sample(df: DataFrame, n: int, seed, key: str = "rid", tag: str = "targets") -> DataFrame:
    """``n`` rows chosen by hash order (the attack's sampling step; a limit is the feature)."""
    return df.withColumn("_u", hash_uniform(seed, tag, key)).orderBy("_u", key).limit(n).drop("_u")
