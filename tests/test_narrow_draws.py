"""Splits and draws keep the rows of a table where they are, with the results of the ranked and joined forms."""

from collections import Counter

from pyspark.sql import functions as F

from tabtwin.operators import generate_dp, generate_l2
from tabtwin.operators.split import hash_rank, stratified_holdout, stratified_split
from tabtwin.spec import ColumnSpec, DPSpec, SplitSpec


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_is_that_of_the_ranks_without_a_window(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(500)], "rid long, g int")
    spec = SplitSpec(train_size=0.6, test_size=0.2, val_size=0.2, stratify_col="g")
    got = stratified_split(rows, spec, 5, allow_null_strata=True)
    assert "Window" not in plan_of(got) and got.columns == ["rid", "g", "split"]
    n = F.col("_n").cast("double")
    first = F.floor(n * 0.6)
    want = hash_rank(rows, 5, "split", "rid", ["g"]).withColumn("split", F.when(F.col("_rank") <= first, "train").when(
        F.col("_rank") <= first + F.floor(n * 0.2), "test").otherwise("val"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select("rid", "g", "split").collect()}


def test_split_sizes_hold_with_repeated_keys(spark):
    rows = spark.createDataFrame([(1, 0)] * 10 + [(None, 0)] * 4 + [(2, 1)], "rid long, g int")
    got = Counter((r.g, r.split) for r in stratified_split(rows, SplitSpec(train_size=0.8, test_size=0.2, stratify_col="g"), 5).collect())
    assert got == {(0, "train"): 11, (0, "test"): 3, (1, "test"): 1}
    held = Counter(r.split for r in stratified_holdout(rows.where("g = 0"), "g", 5).collect())
    assert held == {"train": 9, "test": 5}


def test_dp_rows_are_not_shuffled(spark):
    real = spark.createDataFrame([(i, float(i % 9), "ab"[i % 2]) for i in range(60)], "rid long, x double, c string")
    spec = ColumnSpec(numeric=("x",), binary=(), categorical=("c",))
    dp = DPSpec(bounds={"x": (0.0, 10.0)}, domains={"c": ["a", "b"]}, bins=4, visit_order=("c", "x"), nullable=())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = generate_dp.dp_sweep(real, spec, dp, [1.0, 3.0], 7, noise_seed=1, key="rid")
        assert "SortMergeJoin" not in plan_of(out) and "BroadcastHashJoin" in plan_of(out)
        assert Counter(r.epsilon for r in out.collect()) == {1.0: 60, 3.0: 60}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_few_and_many_levels_are_drawn_alike(spark, monkeypatch):
    real = spark.createDataFrame([(i, float(i % 9) + i / 100, "abc"[i % 3] if i % 5 else None, i % 2) for i in range(90)], "rid long, x double, c string, b int")
    spec = ColumnSpec(numeric=("x",), binary=("b",), categorical=("c",))
    few = generate_l2.generate_l2(real, spec, 3, n=200).collect()
    monkeypatch.setattr(generate_l2, "LEVELS", 0)
    many = generate_l2.generate_l2(real, spec, 3, n=200).collect()
    assert sorted(few, key=lambda r: r.rid) == sorted(many, key=lambda r: r.rid) and len({r.c for r in few}) == 4
