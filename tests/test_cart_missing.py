import numpy as np
import pytest

from tabtwin.operators.generate_cart import generate_cart
from tabtwin.operators.transform import restore_order
from tabtwin.spec import ColumnSpec


def test_missing_rates_by_group_and_values_follow_the_columns_before(spark):
    rng = np.random.default_rng(2)
    rows = [(i, g, None if rng.random() < (0.4 if g == "a" else 0.05) else float((10 if g == "a" else 50) + rng.normal())) for i, g in enumerate(rng.choice(["a", "b"], 4000).tolist())]
    real = spark.createDataFrame(rows, "rid long, g string, x double")
    for node_rows in (1 << 18, 500):                 # in one task, and with large nodes split by histograms
        made = generate_cart(real, ColumnSpec(numeric=("x",), categorical=("g",)), ["g", "x"], 7, node_rows=node_rows)
        assert made.columns == ["rid", "g", "x"] and made.count() == 4000
        rates = {r.g: r.rate for r in made.selectExpr("g", "cast(x IS NULL AS int) AS m").groupBy("g").agg({"m": "avg"}).toDF("g", "rate").collect()}
        want = {g: np.mean([v is None for _, h, v in rows if h == g]) for g in "ab"}
        assert all(abs(rates[g] - want[g]) < 0.03 for g in "ab")
        means = {r.g: r.m for r in made.groupBy("g").avg("x").toDF("g", "m").collect()}
        assert abs(means["a"] - 10) < 0.3 and abs(means["b"] - 50) < 0.3
        assert made.join(real.select("x").distinct(), "x", "left_anti").where("x IS NOT NULL").count() == 0        # donors only


def test_columns_are_put_in_the_real_order_and_types(spark):
    real = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    out = restore_order(spark.createDataFrame([("y", 3, 7, 1)], "c string, a long, b long, d int"), real)
    assert out.schema == real.schema and tuple(out.first()) == (3, 7.0, "y")
    with pytest.raises(ValueError, match="'c'"):
        restore_order(real.drop("c"), real)
