import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabtwin.operators.contract import domain_subset, validate_columns
from tabtwin.operators.split import bootstrap_sample, stratified_split, validate_split
from tabtwin.operators.transform import apply_decisions
from tabtwin.sources.io import load_table, upsert_result, write_table
from tabtwin.spec import ColumnSpec, SplitSpec


@pytest.fixture
def prep(spark):
    rows = [(i, "Other" if i in (3, 7) else ("Male" if i % 2 else "Female"), None if i % 5 == 0 else 20.0 + i, i % 2)
            for i in range(20)]
    return spark.createDataFrame(rows, "id long, gender string, bmi double, target int")


def test_apply_decisions_drops_id_and_rare_level_keeps_missing(prep):
    out = apply_decisions(prep.withColumn("rid", F.col("id")), ("id",), {"gender": ["Other"]})
    assert "id" not in out.columns
    assert out.filter("gender = 'Other'").count() == 0
    assert out.count() == 18
    assert out.filter("bmi IS NULL").count() == 4


def test_split_counts_exact_per_stratum(cohort):
    spec = SplitSpec(train_size=0.8, test_size=0.2, stratify_col="stroke")
    lab = stratified_split(cohort, spec, 24)
    per = {(r["stroke"], r["split"]): r["n"] for r in lab.groupBy("stroke", "split").agg(F.count("*").alias("n")).collect()}
    for s in (0, 1):
        n = per.get((s, "train"), 0) + per.get((s, "test"), 0)
        assert per[(s, "train")] == int(n * 0.8)
    assert lab.count() == cohort.count()


def test_split_with_validation(cohort):
    spec = SplitSpec(train_size=0.6, test_size=0.2, val_size=0.2, stratify_col="gender")
    lab = stratified_split(cohort, spec, 24)
    assert {r[0] for r in lab.select("split").distinct().collect()} == {"train", "test", "val"}


def test_split_independent_of_partitioning(spark, cohort):
    spec = SplitSpec(stratify_col="stroke")
    a = sorted(stratified_split(cohort.repartition(7), spec, 24).select("rid", "split").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = sorted(stratified_split(cohort.repartition(2), spec, 24).select("rid", "split").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_split_raises_on_undersized_group(spark):
    df = spark.createDataFrame([(i, 0 if i < 5 else 1) for i in range(6)], "rid long, target int")
    spec = SplitSpec(stratify_col="target")
    with pytest.raises(ValueError, match="too few"):
        validate_split(stratified_split(df, spec, 24), spec)


def test_split_raises_on_rate_deviation(spark):
    df = spark.createDataFrame([(i, 0) for i in range(100)] + [(100 + i, 1) for i in range(3)], "rid long, target int")
    spec = SplitSpec(stratify_col="target")
    with pytest.raises(ValueError, match="beyond the tolerance"):
        validate_split(stratified_split(df, spec, 24), spec)


def test_bootstrap_exact_size_and_deterministic(cohort):
    a = bootstrap_sample(cohort.select("rid", "age"), 250, 1)
    assert a.count() == 250
    assert sorted(a.collect()) == sorted(bootstrap_sample(cohort.select("rid", "age"), 250, 1).collect())


def test_validate_columns_reports_all_problems_together(spark):
    df = spark.createDataFrame([("M", 1.0, 2.0, 0)], "gender string, age double, bmi double, stroke int")
    spec = ColumnSpec(numeric=("age", "ghost"), binary=("stroke",), categorical=("gender", "age"))
    with pytest.raises(ValueError) as e:
        validate_columns(df, spec)
    msg = str(e.value)
    assert "bmi" in msg and "ghost" in msg and "duplicated age" in msg


def test_domain_subset_catches_recode(spark):
    ref = spark.createDataFrame([(0,), (1,)], "x int")
    cand = spark.createDataFrame([(1,), (2,)], "x int")
    assert [r["value"] for r in domain_subset(ref, cand, ["x"]).collect()] == ["2"]


def test_na_token_round_trip_and_no_overwrite(spark):
    d = tempfile.mkdtemp(prefix="tabtwin-io-")
    path = os.path.join(d, "t.csv")
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("nan"),)], "x double")
    write_table(df, path)
    back = load_table(spark, path)
    assert back.filter("x IS NULL").count() == 2          # null and NaN both come back missing
    assert dict(back.dtypes)["x"] == "double"
    with pytest.raises(ValueError, match="already"):
        write_table(df, path)
    with pytest.raises(FileNotFoundError):
        load_table(spark, os.path.join(d, "missing.csv"))


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "generator string, m double")
    new = spark.createDataFrame([("b", 5.0, 1)], "generator string, m double, extra int")
    got = {r["generator"]: (r["m"], r["extra"]) for r in upsert_result(old, new).collect()}
    assert got == {"a": (1.0, None), "b": (5.0, 1)}
