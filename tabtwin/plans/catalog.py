"""Registered queries: each operator applied to the fixture views of the driver tables.

Every callable takes (spark, sf_dir) and returns a DataFrame whose doubles are rounded to
6 dp (the SQL twins in ``oracles.py`` round the same way). Queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tabtwin.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (comparison with another engine is exact after this)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---- univariate fidelity -------------------------------------------------------------

@register("univariate_fidelity")
def q_univariate(spark, sf_dir):
    from tabtwin.operators.univariate import univariate_fidelity
    real, synth = fx.sides(spark, sf_dir)
    return rounded(univariate_fidelity(real, synth, fx.COHORT_COLUMNS))


@register("ks_distance")
def q_ks(spark, sf_dir):
    from tabtwin.operators.univariate import numeric_distances
    real, synth = fx.sides(spark, sf_dir)
    return rounded(numeric_distances(real, synth, fx.COHORT_COLUMNS.continuous).select("column_name", "ks_distance"))


@register("hellinger_numeric")
def q_hell_num(spark, sf_dir):
    from tabtwin.operators.univariate import numeric_distances
    real, synth = fx.sides(spark, sf_dir)
    return rounded(numeric_distances(real, synth, fx.COHORT_COLUMNS.continuous)
                   .select("column_name", "hellinger_distance"))


@register("hellinger_categorical")
def q_hell_cat(spark, sf_dir):
    from tabtwin.operators.univariate import discrete_distances
    real, synth = fx.sides(spark, sf_dir)
    return rounded(discrete_distances(real, synth, fx.COHORT_COLUMNS.discrete)
                   .select("column_name", "hellinger_distance"))


@register("total_variation")
def q_tvd(spark, sf_dir):
    from tabtwin.operators.univariate import discrete_distances
    real, synth = fx.sides(spark, sf_dir)
    return rounded(discrete_distances(real, synth, fx.COHORT_COLUMNS.discrete).select("column_name", "tvd"))


# ---- sources and sinks ---------------------------------------------------------------

def _scratch(spark, name):
    from tabtwin.session import scratch_path
    return scratch_path(spark, name)


COHORT_TYPES = {"rid": "bigint", "amount": "double", "balance": "double", "month_no": "int", "is_urgent": "int",
                "is_finished": "int", "target": "int", "segment": "string", "region": "string", "priority": "string"}


@register("load_table")
def q_load_table(spark, sf_dir):
    """CSV round trip: write real_side (nulls as NA) then read it back under the declared types."""
    from tabtwin.sources.io import load_table, write_table
    path = _scratch(spark, "load_table") + ".csv"
    write_table(fx.real_side(spark, sf_dir), path)
    return rounded(load_table(spark, path, COHORT_TYPES))


@register("load_table_inferred")
def q_load_table_inferred(spark, sf_dir):
    """Same round trip with type inference (integer / double / string per column)."""
    from tabtwin.sources.io import load_table, write_table
    path = _scratch(spark, "load_inferred") + ".csv"
    write_table(fx.synth_side(spark, sf_dir), path)
    df = load_table(spark, path)
    return rounded(df.select(*[F.col(c) for c in df.columns]))


@register("upsert_result")
def q_upsert(spark, sf_dir):
    """Keyed upsert of per-segment result rows: new rows replace old ones with the same key."""
    from tabtwin.sources.io import upsert_result
    c = fx.cohort(spark, sf_dir)
    old = c.groupBy(F.col("segment").alias("generator")).agg(F.avg("amount").alias("mean_amount"),
                                                             F.count(F.lit(1)).alias("n"))
    new = (c.filter(F.col("segment").isin("BUILDING", "MACHINERY"))
           .groupBy(F.col("segment").alias("generator"))
           .agg(F.avg("balance").alias("mean_balance"), F.count(F.lit(1)).alias("n")))
    return rounded(upsert_result(old, new, "generator"))


# ---- contracts -----------------------------------------------------------------------

@register("domain_subset")
def q_domain_subset(spark, sf_dir):
    """Recoded levels (0/1 -> 1/2) and new categories are caught as values outside the reference."""
    from tabtwin.operators.contract import domain_subset
    real, synth = fx.sides(spark, sf_dir)
    cand = synth.withColumn("is_urgent", F.col("is_urgent") + 1) \
        .withColumn("region", F.when(F.col("rid") % 97 == 0, F.lit("ANTARCTICA")).otherwise(F.col("region")))
    return domain_subset(real, cand, fx.COHORT_COLUMNS.discrete)


@register("strat_rate_check")
def q_strat_rate(spark, sf_dir):
    from tabtwin.operators.contract import strat_rate_check
    from tabtwin.operators.split import stratified_split
    labelled = stratified_split(fx.real_side(spark, sf_dir), fx.COHORT_SPLIT, fx.COHORT_SEED)
    return rounded(strat_rate_check(labelled, "target"))


@register("empty_partition_check")
def q_empty_partition(spark, sf_dir):
    """Strata (segment x region x priority) too small to give rows to every split of 90/5/5."""
    from tabtwin.operators.contract import empty_partition_check
    from tabtwin.operators.split import stratified_split
    from tabtwin.spec import SplitSpec
    c = fx.cohort(spark, sf_dir).withColumn("stratum", F.concat_ws("/", "segment", "region", "priority",
                                                                    F.col("month_no").cast("string")))
    spec = SplitSpec(train_size=0.9, test_size=0.05, val_size=0.05, stratify_col="stratum")
    labelled = stratified_split(c, spec, fx.COHORT_SEED)
    return empty_partition_check(labelled, "stratum", splits=("train", "test", "val"))


# ---- transforms ----------------------------------------------------------------------

@register("apply_decisions")
def q_decisions(spark, sf_dir):
    """Drop the key column and every row of the rare level, keeping rows with a missing level."""
    from tabtwin.operators.transform import apply_decisions
    c = fx.cohort(spark, sf_dir)
    out = apply_decisions(c.withColumn("id", F.col("rid")), ("id",), {"priority": ["5-LOW"]})
    return rounded(out)


@register("apply_types")
def q_apply_types(spark, sf_dir):
    from tabtwin.operators.transform import apply_types
    return rounded(apply_types(fx.real_side(spark, sf_dir), fx.COHORT_COLUMNS))


@register("restore_types")
def q_restore_types(spark, sf_dir):
    """String labels and fractional values cast back to the real schema (integers half-even)."""
    from tabtwin.operators.transform import restore_types
    real, synth = fx.sides(spark, sf_dir)
    labels = synth.select(
        "rid", (F.col("amount") * 2).alias("amount"), F.col("balance").cast("string").alias("balance"),
        (F.col("month_no") + F.lit(0.5)).alias("month_no"), F.col("is_urgent").cast("string").alias("is_urgent"),
        F.col("is_finished").cast("string").alias("is_finished"), (F.col("target") - F.lit(0.5)).alias("target"),
        "segment", "region", "priority")
    return rounded(restore_types(labels, real.schema))


@register("missing_indicator")
def q_missing_indicator(spark, sf_dir):
    from tabtwin.operators.transform import missing_indicator
    c = fx.cohort(spark, sf_dir)
    return c.select("rid", missing_indicator("balance"), missing_indicator("priority"))


@register("band")
def q_band(spark, sf_dir):
    from tabtwin.functions.binning import band
    c = fx.cohort(spark, sf_dir)
    return c.select("rid", band(F.col("amount"), [0, 100000, 200000, 300000, 400000, 500000]).alias("amount_band"))


@register("discretise")
def q_discretise(spark, sf_dir):
    from tabtwin.operators.transform import discretise
    return discretise(fx.real_side(spark, sf_dir), fx.COHORT_DP.bounds, 10)


@register("undiscretise")
def q_undiscretise(spark, sf_dir):
    from tabtwin.operators.transform import discretise, undiscretise
    coded = discretise(fx.real_side(spark, sf_dir), fx.COHORT_DP.bounds, 10)
    return rounded(undiscretise(coded, fx.COHORT_DP.bounds, 10))


@register("impute_from_reference")
def q_impute(spark, sf_dir):
    """Blank out some cells of synth_side, then refill complete-in-real columns from real_side."""
    from tabtwin.operators.transform import impute_from_reference
    real, synth = fx.sides(spark, sf_dir)
    holes = synth.select(*[F.when(F.col("rid") % 13 == 0, F.lit(None)).otherwise(F.col(c)).alias(c)
                           if c != "rid" else F.col(c) for c in synth.columns])
    return rounded(impute_from_reference(holes, real, fx.COHORT_COLUMNS))


# ---- splits and sampling -------------------------------------------------------------

@register("stratified_split")
def q_split(spark, sf_dir):
    from tabtwin.operators.split import stratified_split
    labelled = stratified_split(fx.real_side(spark, sf_dir), fx.COHORT_SPLIT, fx.COHORT_SEED)
    return labelled.select("rid", "target", "split")


@register("stratified_split_val")
def q_split_val(spark, sf_dir):
    from tabtwin.operators.split import stratified_split
    from tabtwin.spec import SplitSpec
    spec = SplitSpec(train_size=0.7, test_size=0.15, val_size=0.15, stratify_col="segment")
    return stratified_split(fx.cohort(spark, sf_dir), spec, 7).select("rid", "segment", "split")


@register("seeded_shuffle")
def q_shuffle(spark, sf_dir):
    from tabtwin.operators.split import hash_rank
    ranked = hash_rank(fx.real_side(spark, sf_dir), fx.COHORT_SEED, "shuffle", "rid")
    return ranked.select("rid", F.col("_rank").alias("position"))


@register("stratified_holdout")
def q_holdout(spark, sf_dir):
    from tabtwin.operators.split import stratified_holdout
    real, synth = fx.sides(spark, sf_dir)
    both = real.select("rid", F.lit(1).alias("is_real")).unionByName(synth.select("rid", F.lit(0).alias("is_real")))
    return stratified_holdout(both, "is_real", fx.COHORT_SEED).select("rid", "is_real", "split")


@register("bootstrap_sample")
def q_bootstrap(spark, sf_dir):
    from tabtwin.operators.split import bootstrap_sample
    real = fx.real_side(spark, sf_dir)
    n = real.count()
    return bootstrap_sample(real.select("rid", "amount"), n, fx.COHORT_SEED).select("draw_id", "rid", "amount")


@register("attack_target_sample")
def q_targets(spark, sf_dir):
    from tabtwin.operators.split import attack_target_sample
    return attack_target_sample(fx.real_side(spark, sf_dir), 200, fx.COHORT_SEED).select("rid", "segment", "amount")


# ---- profile (EDA) -------------------------------------------------------------------

@register("value_counts")
def q_value_counts(spark, sf_dir):
    from tabtwin.operators.profile import value_counts_table
    return rounded(value_counts_table(fx.cohort(spark, sf_dir), fx.COHORT_COLUMNS.discrete))


@register("describe")
def q_describe(spark, sf_dir):
    from tabtwin.operators.profile import describe
    return rounded(describe(fx.cohort(spark, sf_dir), fx.COHORT_COLUMNS.continuous))


@register("describe_lineitem")
def q_describe_lineitem(spark, sf_dir):
    from tabtwin.operators.profile import describe
    fx.register_tables(spark, sf_dir, ("lineitem",))
    return rounded(describe(spark.table("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@register("missing_profile")
def q_missing(spark, sf_dir):
    from tabtwin.operators.profile import missing_profile
    return rounded(missing_profile(fx.cohort(spark, sf_dir)))


@register("group_missing_rate")
def q_group_missing(spark, sf_dir):
    from tabtwin.operators.profile import group_missing_rate
    return rounded(group_missing_rate(fx.cohort(spark, sf_dir), "balance",
                                      ["target", "is_urgent", "is_finished", "segment", "priority"]))


@register("group_target_rate")
def q_group_target(spark, sf_dir):
    from tabtwin.operators.profile import group_target_rate
    return rounded(group_target_rate(fx.cohort(spark, sf_dir), "target", ["is_urgent", "segment", "region",
                                                                          "priority"]))


@register("class_balance")
def q_class_balance(spark, sf_dir):
    from tabtwin.operators.profile import class_balance
    return rounded(class_balance(fx.cohort(spark, sf_dir), "target"))


@register("conditional_mean_shift")
def q_mean_shift(spark, sf_dir):
    from tabtwin.operators.profile import conditional_mean_shift
    return rounded(conditional_mean_shift(fx.cohort(spark, sf_dir), "target", fx.COHORT_COLUMNS.continuous))


@register("extremes")
def q_extremes(spark, sf_dir):
    from tabtwin.operators.profile import extremes
    return rounded(extremes(fx.cohort(spark, sf_dir), fx.COHORT_COLUMNS.continuous))


@register("histogram_table")
def q_histogram(spark, sf_dir):
    from tabtwin.operators.profile import histogram_table
    return rounded(histogram_table(fx.cohort(spark, sf_dir), fx.COHORT_COLUMNS.continuous, 10, by="target")
                   .select("column_name", "target", "bin", "lo", "hi", "count",
                           (F.col("density") * (F.col("hi") - F.col("lo"))).alias("share")))


@register("kde_table")
def q_kde(spark, sf_dir):
    """KDE curves; density reported times the column's grid span so 6 dp keep the shape."""
    from tabtwin.operators.profile import kde_table
    real, synth = fx.sides(spark, sf_dir)
    k = kde_table(real, synth, ["amount", "balance", "month_no"])
    of_column = Window.partitionBy("column_name")          # 200 grid points
    span = F.max("x").over(of_column) - F.min("x").over(of_column)
    return rounded(k.select("column_name", "side", "grid_index", (F.col("density") * span).alias("scaled_density")))


@register("k_anonymity_profile")
def q_kanon(spark, sf_dir):
    from tabtwin.operators.profile import k_anonymity_profile
    return k_anonymity_profile(fx.cohort(spark, sf_dir), list(fx.COHORT_COLUMNS.categorical) + ["is_urgent"], 5)


@register("k_anonymity_quasi_identifiers")
def q_kanon_qi(spark, sf_dir):
    from tabtwin.functions.binning import band
    from tabtwin.operators.profile import k_anonymity_profile
    c = fx.cohort(spark, sf_dir).withColumn(
        "amount_band", band(F.col("amount"), [0, 100000, 200000, 300000, 400000, 500000]))
    return k_anonymity_profile(c, ["segment", "region", "is_urgent", "month_no", "amount_band"], 5)


@register("rarest_combos")
def q_rarest(spark, sf_dir):
    from tabtwin.operators.profile import rarest_combos
    return rarest_combos(fx.cohort(spark, sf_dir), ["segment", "region", "priority", "is_urgent"], 10)


@register("duplicate_rows")
def q_duplicates(spark, sf_dir):
    from tabtwin.operators.profile import duplicate_rows
    fx.register_tables(spark, sf_dir, ("lineitem",))
    return duplicate_rows(spark.table("lineitem"))


@register("pearson_matrix")
def q_pearson(spark, sf_dir):
    from tabtwin.operators.profile import pearson_matrix
    cols = fx.COHORT_COLUMNS.continuous + list(fx.COHORT_COLUMNS.binary)
    return rounded(pearson_matrix(fx.cohort(spark, sf_dir), cols))


@register("head")
def q_head(spark, sf_dir):
    from tabtwin.operators.profile import head
    return rounded(head(fx.cohort(spark, sf_dir), "rid", 5))


@register("schema_info")
def q_schema_info(spark, sf_dir):
    from tabtwin.operators.profile import schema_info
    return schema_info(fx.cohort(spark, sf_dir))


# ---- association, missingness, plausibility ---------------------------------------------

def _kinds():
    spec = fx.COHORT_COLUMNS
    from tabtwin.operators.association import matrix_order
    from tabtwin.operators.transform import upper_triangle
    names = matrix_order(spec)
    cont = set(spec.numeric)
    pairs = upper_triangle(names)
    return ([p for p in pairs if p[0] in cont and p[1] in cont],
            [p for p in pairs if (p[0] in cont) != (p[1] in cont)],
            [p for p in pairs if p[0] not in cont and p[1] not in cont])


@register("abs_pearson")
def q_abs_pearson(spark, sf_dir):
    from tabtwin.operators.association import abs_pearson_pairs
    return rounded(abs_pearson_pairs(fx.real_side(spark, sf_dir), _kinds()[0]))


@register("correlation_ratio")
def q_eta(spark, sf_dir):
    from tabtwin.operators.association import correlation_ratio_pairs
    pairs = [(b, a) for a, b in _kinds()[1]]   # (discrete, numeric)
    return rounded(correlation_ratio_pairs(fx.real_side(spark, sf_dir), pairs))


@register("cramers_v")
def q_cramers(spark, sf_dir):
    from tabtwin.operators.association import cramers_v_pairs
    return rounded(cramers_v_pairs(fx.real_side(spark, sf_dir), _kinds()[2]))


@register("pairwise_association")
def q_pairwise(spark, sf_dir):
    from tabtwin.operators.association import association_pairs
    return rounded(association_pairs(fx.synth_side(spark, sf_dir), fx.COHORT_COLUMNS))


@register("association_matrix")
def q_assoc_matrix(spark, sf_dir):
    from tabtwin.operators.association import association_matrix
    return rounded(association_matrix(fx.real_side(spark, sf_dir), fx.COHORT_COLUMNS))


@register("named_pair_checks")
def q_named(spark, sf_dir):
    from tabtwin.operators.association import compare_associations, named_pair_checks
    real, synth = fx.sides(spark, sf_dir)
    return rounded(named_pair_checks(compare_associations(real, synth, fx.COHORT_COLUMNS), fx.COHORT_NAMED_PAIRS))


@register("association_mae")
def q_assoc_mae(spark, sf_dir):
    from tabtwin.operators.association import association_mae, compare_associations
    real, synth = fx.sides(spark, sf_dir)
    return rounded(association_mae(compare_associations(real, synth, fx.COHORT_COLUMNS)))


@register("association_diff")
def q_assoc_diff(spark, sf_dir):
    from tabtwin.operators.association import association_diff
    real, synth = fx.sides(spark, sf_dir)
    return rounded(association_diff(real, synth, fx.COHORT_COLUMNS))


@register("cramers_v_matrix")
def q_cramers_matrix(spark, sf_dir):
    from tabtwin.operators.association import cramers_v_matrix
    return rounded(cramers_v_matrix(fx.cohort(spark, sf_dir), list(fx.COHORT_COLUMNS.categorical) +
                                    ["is_urgent", "target"]))


@register("missingness_comparison")
def q_missingness(spark, sf_dir):
    from tabtwin.operators.quality import missingness_comparison
    real, synth = fx.sides(spark, sf_dir)
    return rounded(missingness_comparison(real, synth, fx.COHORT_COLUMNS.all_columns))


@register("plausibility_checks")
def q_plausibility(spark, sf_dir):
    from tabtwin.operators.quality import plausibility_checks
    return plausibility_checks(fx.synth_side(spark, sf_dir), fx.COHORT_PLAUSIBILITY)


@register("fidelity_row")
def q_fidelity_row(spark, sf_dir):
    """One row of fidelity aggregates (detection AUC is model-based and reported by the job)."""
    from tabtwin.operators.association import association_mae, compare_associations, named_pair_checks
    from tabtwin.operators.quality import missingness_comparison, missingness_mae, n_implausible, plausibility_checks
    from tabtwin.operators.univariate import univariate_fidelity, univariate_summary
    from tabtwin.session import cut_lineage
    real, synth = fx.sides(spark, sf_dir)
    spec = fx.COHORT_COLUMNS
    uni = univariate_summary(univariate_fidelity(real, synth, spec))
    comp = compare_associations(real, synth, spec)
    comp = cut_lineage(comp)                                     # a row per pair, read twice
    mae = association_mae(comp)
    named = named_pair_checks(comp, fx.COHORT_NAMED_PAIRS).agg(F.max("abs_diff").alias("named_max_abs_diff"))
    miss = missingness_mae(missingness_comparison(real, synth, spec.all_columns))
    impl = n_implausible(plausibility_checks(synth, fx.COHORT_PLAUSIBILITY))
    ones = [(part.columns[0], part.scalar()) for part in (mae, named, miss, impl)]        # one-row aggregates
    return rounded(uni.select(F.lit("synth_side").alias("generator"), "*", *[value.alias(name) for name, value in ones]))


# ---- scoring -------------------------------------------------------------------------

def _score_table(spark, sf_dir):
    c = fx.cohort(spark, sf_dir)
    return c.select("rid", F.col("target").alias("label"), F.round(F.col("amount") / 500000.0, 2).alias("score"),
                    "segment")


@register("roc_auc")
def q_roc(spark, sf_dir):
    from tabtwin.operators.scoring import roc_auc
    return rounded(roc_auc(_score_table(spark, sf_dir), group=["segment"]))


@register("average_precision")
def q_ap(spark, sf_dir):
    from tabtwin.operators.scoring import average_precision
    return rounded(average_precision(_score_table(spark, sf_dir), group=["segment"]))


@register("f1_positive")
def q_f1(spark, sf_dir):
    from tabtwin.operators.scoring import f1_positive
    t = _score_table(spark, sf_dir).withColumn("prediction", (F.col("score") >= 0.75).cast("int"))
    return rounded(f1_positive(t, group=["segment"]))


@register("pr_auc_baseline")
def q_prevalence(spark, sf_dir):
    from tabtwin.operators.scoring import pr_auc_baseline
    return rounded(pr_auc_baseline(_score_table(spark, sf_dir)))


# ---- generators ------------------------------------------------------------------------

def _l2(spark, sf_dir):
    from tabtwin.operators.generate_l2 import generate_l2
    train, _ = fx.train_test(spark, sf_dir)
    return generate_l2(train, fx.COHORT_COLUMNS, fx.COHORT_SEED, key="rid")


@register("generate_l2")
def q_generate_l2(spark, sf_dir):
    return rounded(_l2(spark, sf_dir))


@register("synth_numeric_l2")
def q_synth_numeric(spark, sf_dir):
    return rounded(_l2(spark, sf_dir).select("rid", *fx.COHORT_COLUMNS.continuous))


@register("synth_categorical_l2")
def q_synth_categorical(spark, sf_dir):
    return _l2(spark, sf_dir).select("rid", *fx.COHORT_COLUMNS.discrete)


# ---- privacy -------------------------------------------------------------------------

def _privacy_inputs(spark, sf_dir):
    train, test = fx.train_test(spark, sf_dir)
    return train, test, fx.synth_side(spark, sf_dir)


@register("nearest_record")
def q_nearest(spark, sf_dir):
    from tabtwin.operators.knn import knn, numeric_ranges
    train, _, synth = _privacy_inputs(spark, sf_dir)
    spec = fx.COHORT_COLUMNS
    nn = knn(synth.withColumnRenamed("rid", "qid"), train, spec.continuous, spec.discrete, 1, "qid", "rid",
             numeric_ranges(train, spec.continuous))
    return rounded(nn.select("qid", "rid", "distance"))


@register("nearest_records_k10")
def q_nearest_k10(spark, sf_dir):
    from tabtwin.operators.knn import knn, numeric_ranges
    from tabtwin.operators.split import attack_target_sample
    train, _, synth = _privacy_inputs(spark, sf_dir)
    spec = fx.COHORT_COLUMNS
    targets = attack_target_sample(train, 200, fx.COHORT_SEED, "rid", "link#main").withColumnRenamed("rid", "qid")
    nn = knn(targets, synth, spec.continuous, spec.discrete, 10, "qid", "rid", numeric_ranges(train, spec.continuous))
    return rounded(nn.select("qid", "rid", "distance", "rank"))


@register("dcr_overfitting_protection")
def q_dcr_over(spark, sf_dir):
    from tabtwin.operators.privacy import dcr_overfitting_protection
    train, test, synth = _privacy_inputs(spark, sf_dir)
    return rounded(dcr_overfitting_protection(train, test, synth, fx.COHORT_COLUMNS))


@register("dcr_baseline_protection")
def q_dcr_base(spark, sf_dir):
    from tabtwin.operators.privacy import dcr_baseline_protection
    train, _, synth = _privacy_inputs(spark, sf_dir)
    return rounded(dcr_baseline_protection(train, synth, fx.COHORT_COLUMNS, fx.COHORT_SEED))


@register("membership_inference")
def q_membership(spark, sf_dir):
    from tabtwin.operators.privacy import membership_inference
    train, test, synth = _privacy_inputs(spark, sf_dir)
    return rounded(membership_inference(train, test, synth, fx.COHORT_COLUMNS))


@register("membership_classifier")
def q_membership_classifier(spark, sf_dir):
    from tabtwin.operators.privacy import membership_classifier
    train, test, synth = _privacy_inputs(spark, sf_dir)
    return rounded(membership_classifier(train, test, synth, fx.COHORT_COLUMNS, fx.COHORT_SEED))


@register("risk_with_ci")
def q_risk(spark, sf_dir):
    """Wilson-interval risk arithmetic on per-segment success counts drawn from the cohort."""
    from tabtwin.operators.privacy import risk_with_ci
    c = fx.cohort(spark, sf_dir)
    counts = c.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_attacks"), F.count_if(F.col("is_urgent") == 1).alias("attack_successes"),
        F.count(F.lit(1)).alias("control_n"), F.count_if(F.col("target") == 1).alias("control_successes"),
        F.count_if(F.col("is_finished") == 1).alias("baseline_successes"))
    return rounded(risk_with_ci(counts))


@register("singling_out_univariate")
def q_so_uni(spark, sf_dir):
    from tabtwin.operators.attacks import singling_out
    train, test, synth = _privacy_inputs(spark, sf_dir)
    return rounded(singling_out(train, test, synth, fx.COHORT_COLUMNS, "univariate", 200, fx.COHORT_SEED))


@register("singling_out_multivariate")
def q_so_multi(spark, sf_dir):
    from tabtwin.operators.attacks import singling_out
    train, test, synth = _privacy_inputs(spark, sf_dir)
    return rounded(singling_out(train, test, synth, fx.COHORT_COLUMNS, "multivariate", 200, fx.COHORT_SEED))


@register("linkability")
def q_linkability(spark, sf_dir):
    from tabtwin.operators.attacks import linkability, role_halves
    train, test, synth = _privacy_inputs(spark, sf_dir)
    return rounded(linkability(train, test, synth, fx.COHORT_COLUMNS, role_halves(fx.COHORT_ROLES), 200, fx.COHORT_SEED))


def _inference_rows(spark, sf_dir):
    from tabtwin.operators.attacks import inference_risks, role_secrets
    train, test, synth = _privacy_inputs(spark, sf_dir)
    roles = fx.COHORT_ROLES
    return inference_risks(train, test, synth, fx.COHORT_COLUMNS, role_secrets(roles), roles.regression_secrets, 200, fx.COHORT_SEED)


@register("inference")
def q_inference(spark, sf_dir):
    return rounded(_inference_rows(spark, sf_dir))


@register("inference_summary")
def q_inference_summary(spark, sf_dir):
    from tabtwin.operators.attacks import inference_summary
    return rounded(inference_summary(_inference_rows(spark, sf_dir)))


@register("release_gate")
def q_release_gate(spark, sf_dir):
    """Every risk of the synthetic table vs the same risks when the holdout is released instead."""
    from tabtwin.operators.attacks import risk_metrics
    from tabtwin.operators.privacy import release_gate
    from tabtwin.session import cut_lineage
    train, test, synth = (cut_lineage(df) for df in _privacy_inputs(spark, sf_dir))     # each is read by every attack
    half = test.withColumn("_h", F.col("rid") % 2)
    hold_a, hold_b = half.filter("_h = 0").drop("_h"), half.filter("_h = 1").drop("_h")

    def risks(candidate, control):
        return risk_metrics(train, control, candidate, fx.COHORT_COLUMNS, fx.COHORT_ROLES, 200, fx.COHORT_SEED)

    return rounded(release_gate(risks(synth, test), risks(hold_a, hold_b)))


@register("dp_marginals")
def q_dp_marginals(spark, sf_dir):
    """Noisy marginal counts over the full public domain (fixed noise seed for testing)."""
    from tabtwin.operators.generate_dp import noisy_marginals
    from tabtwin.operators.transform import discretise
    train, _ = fx.train_test(spark, sf_dir)
    coded = discretise(train, fx.COHORT_DP.bounds, 10, columns=fx.COHORT_COLUMNS.all_columns)
    nm = noisy_marginals(coded, fx.COHORT_COLUMNS, fx.COHORT_DP, 3.0, 1234)
    return rounded(nm.select("mid", F.concat_ws("|", "cell").alias("cell"), "noisy"))


@register("generate_dp")
def q_generate_dp(spark, sf_dir):
    from tabtwin.operators.generate_dp import generate_dp
    train, _ = fx.train_test(spark, sf_dir)
    return rounded(generate_dp(train, fx.COHORT_COLUMNS, fx.COHORT_DP, 3.0, fx.COHORT_SEED, noise_seed=1234,
                               key="rid"))


@register("dp_sweep")
def q_dp_sweep(spark, sf_dir):
    """Row counts and mean amount per epsilon of the sweep (0.5, 1, 3, 8)."""
    from tabtwin.operators.generate_dp import dp_sweep
    from tabtwin.spec import DP_EPSILONS
    train, _ = fx.train_test(spark, sf_dir)
    sweep = dp_sweep(train, fx.COHORT_COLUMNS, fx.COHORT_DP, DP_EPSILONS, fx.COHORT_SEED, noise_seed=1234, key="rid")
    return rounded(sweep.groupBy("epsilon").agg(F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean_amount")))


# ---- model-based ---------------------------------------------------------------------

@register("preprocess_features")
def q_features(spark, sf_dir):
    from tabtwin.operators.models import preprocess_features
    train, test = fx.train_test(spark, sf_dir)
    plan = preprocess_features(train, fx.COHORT_COLUMNS, "target")
    return rounded(plan.transform(test).select("rid", F.posexplode("features").alias("place", "value")))


@register("detection_auc")
def q_detection(spark, sf_dir):
    from tabtwin.operators.models import detection_auc
    real, synth = fx.sides(spark, sf_dir)
    return rounded(detection_auc(real, synth, fx.COHORT_COLUMNS, fx.COHORT_SEED))


@register("tstr_trtr")
def q_tstr(spark, sf_dir):
    from tabtwin.operators.models import tstr_trtr
    train, test = fx.train_test(spark, sf_dir)
    synth = fx.synth_side(spark, sf_dir)
    return rounded(tstr_trtr(train, test, synth, fx.COHORT_COLUMNS, "target", fx.COHORT_SEED))


# ---- jobs and file-level operators -----------------------------------------------------

def _write_cohort_csv(spark, sf_dir, name):
    from tabtwin.sources.io import write_table
    base = _scratch(spark, name)
    path = f"{base}/raw.csv"
    c = fx.cohort(spark, sf_dir)
    # the raw file carries an identifier column and the rare level the decisions drop
    write_table(c.withColumn("id", F.col("rid")).drop("rid"), path)
    return base, path


@register("prepare_job")
def q_prepare(spark, sf_dir):
    """Load a raw CSV, drop the id and the '5-LOW' priority rows, stratified split, write."""
    from tabtwin.plans.jobs import prepare_job
    base, path = _write_cohort_csv(spark, sf_dir, "prepare")
    labelled = prepare_job(spark, path, f"{base}/processed", fx.COHORT_SPLIT, fx.COHORT_SEED,
                           drop_columns=("id",), exclude={"priority": ["5-LOW"]}, key="rid", key_source="id",
                           types=dict(COHORT_TYPES, id="bigint"))
    return labelled.groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"))


@register("write_splits")
def q_write_splits(spark, sf_dir):
    """Write train/test, then read back what landed on disk; a second write is refused."""
    from tabtwin.operators.split import stratified_split
    from tabtwin.sources.io import load_table, write_splits
    base = _scratch(spark, "splits")
    labelled = stratified_split(fx.real_side(spark, sf_dir), fx.COHORT_SPLIT, fx.COHORT_SEED)
    paths = write_splits(labelled, base)
    try:
        write_splits(labelled, base)
        refused = False
    except ValueError:
        refused = True
    parts = [load_table(spark, p, COHORT_TYPES).select(F.lit(n).alias("split"), "rid") for n, p in sorted(paths.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("second_write_refused", F.lit(refused))


@register("compat_report")
def q_compat(spark, sf_dir):
    """Schema + domain problems of two candidate files and one missing file."""
    from tabtwin.operators.contract import compat_report
    from tabtwin.sources.io import load_table, write_table
    base = _scratch(spark, "compat")
    real, synth = fx.sides(spark, sf_dir)
    bad = synth.withColumn("is_urgent", F.col("is_urgent") + 1).drop("priority")
    write_table(synth, f"{base}/good.csv")
    write_table(bad, f"{base}/recoded.csv")
    ref = load_table(spark, f"{base}/good.csv")
    cands = {"good.csv": f"{base}/good.csv", "recoded.csv": f"{base}/recoded.csv", "absent.csv": f"{base}/absent.csv"}
    return compat_report(spark, ref, cands, fx.COHORT_COLUMNS.discrete)


@register("evaluate_job")
def q_evaluate(spark, sf_dir):
    """Fidelity + utility + privacy with all attacks for the L2 generator's table."""
    from tabtwin.operators.generate_l2 import generate_l2
    from tabtwin.plans.jobs import evaluate_job
    train, test = fx.train_test(spark, sf_dir)
    synth = generate_l2(train, fx.COHORT_COLUMNS, fx.COHORT_SEED, key="rid")
    row = evaluate_job(spark, train, test, synth, "low_fidelity", fx.COHORT_COLUMNS, fx.COHORT_ROLES,
                       fx.COHORT_NAMED_PAIRS, fx.COHORT_PLAUSIBILITY, fx.COHORT_SEED,
                       results_path=_scratch(spark, "results"))
    return rounded(row)


@register("generate_cart")
def q_generate_cart(spark, sf_dir):
    from tabtwin.operators.generate_cart import generate_cart
    train, _ = fx.train_test(spark, sf_dir)
    order = list(fx.COHORT_DP.visit_order)
    return rounded(generate_cart(train, fx.COHORT_COLUMNS, order, fx.COHORT_SEED, key="rid"))
