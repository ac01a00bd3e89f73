"""No row, level or value goes missing without a word."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtwin.operators.generate_dp import coded_rows, marginal_counts
from tabtwin.operators.generate_l2 import generate_l2
from tabtwin.operators.scoring import average_precision, roc_auc
from tabtwin.operators.split import stratified_split
from tabtwin.operators.transform import restore_types
from tabtwin.session import checkpoint_dir
from tabtwin.sources.io import load_table, write_splits, write_table
from tabtwin.spec import ColumnSpec, DPSpec, SplitSpec


def test_null_strata_raise_or_are_a_stratum(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(200)], "rid long, target int")
    spec = SplitSpec(stratify_col="target")
    with pytest.raises(ValueError, match="50 rows"):
        stratified_split(df, spec, 1)
    out = stratified_split(df, spec, 1, allow_null_strata=True)
    assert out.count() == 200
    nulls = {r["split"]: r["count"] for r in out.where("target IS NULL").groupBy("split").count().collect()}
    assert nulls["train"] == int(50 * spec.train_size) and sum(nulls.values()) == 50


def test_cells_that_do_not_fit_raise(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("a,b\n1,x\nbad,y\n,z\n")
    with pytest.raises(ValueError, match="1 in a as int"):
        load_table(spark, path, {"a": "int"})
    assert load_table(spark, path).schema["a"].dataType == T.StringType()


def test_quotes_line_breaks_and_spaces_survive(spark, tmp_path):
    rows = [('he said "hi", ok', 1.5), (" x", float("nan")), ("two\nlines", None), ("NA ", 2.0)]
    write_table(spark.createDataFrame(rows, "t string, v double").coalesce(1), str(tmp_path / "out"))
    back = load_table(spark, str(tmp_path / "out"), multi_line=True)
    assert back.schema["v"].dataType == T.DoubleType()
    assert sorted(map(tuple, back.collect()), key=str) == sorted([('he said "hi", ok', 1.5), (" x", None), ("two\nlines", None), (None, 2.0)], key=str)


def test_unknown_split_labels_raise_before_anything_is_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "other"), (3, None)], "rid long, split string")
    with pytest.raises(ValueError, match="2 rows"):
        write_splits(df, str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_long_integers_are_exact(spark):
    df = spark.createDataFrame([("9007199254740993",), ("2.5",), (None,)], "n string")
    out = restore_types(df, T.StructType([T.StructField("n", T.LongType())])).collect()
    assert [r.n for r in out] == [9007199254740993, 2, None]


def test_a_null_group_is_a_group_and_null_scores_raise(spark):
    df = spark.createDataFrame([(g, int(s > 0.5), s) for g in (None, "a") for s in (0.1, 0.4, 0.6, 0.9)], "g string, label int, score double")
    assert {(r.g, r.roc_auc) for r in roc_auc(df, group=["g"]).collect()} == {(None, 1.0), ("a", 1.0)}
    assert {(r.g, r.average_precision) for r in average_precision(df, group=["g"]).collect()} == {(None, 1.0), ("a", 1.0)}
    with pytest.raises(Exception, match="no value in the score column"):
        roc_auc(df.union(spark.createDataFrame([("a", 1, None)], df.schema))).collect()


def test_private_marginals_count_every_row(spark):
    spec = ColumnSpec(numeric=["x"], binary=[], categorical=["c"])
    dp = DPSpec(bounds={"x": (0.0, 10.0)}, domains={"c": ["a", "b"]}, nullable=[], visit_order=["x", "c"])
    df = spark.createDataFrame([(float(i % 20 - 5), "ab"[i % 2]) for i in range(200)], "x double, c string")
    totals = {r.mid: r.n for r in marginal_counts(coded_rows(df, spec, dp), spec, dp).groupBy("mid").agg(F.sum("n").alias("n")).collect()}
    assert set(totals.values()) == {200}
    with pytest.raises(ValueError, match="1 in c"):
        marginal_counts(coded_rows(df.union(spark.createDataFrame([(1.0, "new")], df.schema)), spec, dp), spec, dp)
    with pytest.raises(ValueError, match="1 in x"):
        marginal_counts(coded_rows(df.union(spark.createDataFrame([(None, "a")], df.schema)), spec, dp), spec, dp)


def test_twelve_thousand_levels_are_drawn_by_their_counts(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, f"l{i % 12_000}" if i % 3 else "top", float(x)) for i, x in enumerate(rng.normal(size=30_000))], "rid long, c string, x double")
    spec = ColumnSpec(numeric=["x"], binary=[], categorical=["c"])
    out = generate_l2(df, spec, 3)
    assert out.count() == 30_000 and out.where("c IS NULL OR x IS NULL").count() == 0
    assert abs(out.where("c = 'top'").count() / 30_000 - 1 / 3) < 0.02
    assert out.select("c").distinct().count() > 5_000


def test_checkpoint_folder_must_be_named():
    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
