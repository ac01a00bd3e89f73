import numpy as np
import pytest
from pyspark.sql import functions as F

from tabtwin.operators.generate_dp import generate_dp
from tabtwin.operators.generate_l2 import generate_l2
from health_table import STROKE_DP_BOUNDS, STROKE_VISIT_ORDER
from tabtwin.spec import ColumnSpec, DPSpec


@pytest.fixture(scope="module")
def l2(cohort, cohort_spec):
    return generate_l2(cohort, cohort_spec, 24, key="rid").cache()


def test_l2_same_columns_types_rows(cohort, l2):
    assert l2.columns == cohort.columns
    assert l2.dtypes == cohort.dtypes
    assert l2.count() == cohort.count()


def test_l2_deterministic(cohort, cohort_spec, l2):
    again = generate_l2(cohort, cohort_spec, 24, key="rid")
    assert sorted(l2.collect()) == sorted(again.collect())


def test_l2_known_categories_and_missing_rate(cohort, l2):
    real = {r[0] for r in cohort.select("work_type").distinct().collect()}
    assert {r[0] for r in l2.select("work_type").distinct().collect()} <= real
    rate_real = cohort.filter("bmi IS NULL").count() / cohort.count()
    rate_syn = l2.filter("bmi IS NULL").count() / l2.count()
    assert abs(rate_real - rate_syn) < 0.05


def test_l2_destroys_correlation(spark):
    rng = np.random.default_rng(0)
    age = rng.uniform(1, 80, 500)
    bmi = 0.3 * age + rng.normal(0, 1, 500)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(age, bmi))],
                               "rid long, age double, bmi double")
    spec = ColumnSpec(numeric=("age", "bmi"))
    assert df.stat.corr("age", "bmi") > 0.8
    syn = generate_l2(df, spec, 24, key="rid")
    assert abs(syn.stat.corr("age", "bmi")) < 0.2




def _dp_spec(cohort, cohort_spec):
    domains = {c: sorted({str(r[0]) for r in cohort.select(c).distinct().collect() if r[0] is not None})
               for c in cohort_spec.discrete}
    return DPSpec(bounds=STROKE_DP_BOUNDS, domains=domains, bins=10, visit_order=STROKE_VISIT_ORDER, nullable=("bmi",))


def test_dp_rejects_nonpositive_epsilon(cohort, cohort_spec):
    with pytest.raises(ValueError, match="strictly positive"):
        generate_dp(cohort, cohort_spec, _dp_spec(cohort, cohort_spec), 0.0, 24)


def test_dp_shape_bounds_and_nulls(cohort, cohort_spec):
    syn = generate_dp(cohort, cohort_spec, _dp_spec(cohort, cohort_spec), 8.0, 24, noise_seed=7, key="rid").cache()
    assert syn.columns == cohort.columns
    assert syn.count() == cohort.count()
    for c, (lo, hi) in STROKE_DP_BOUNDS.items():
        r = syn.agg(F.min(c), F.max(c)).first()
        assert lo <= r[0] and r[1] <= hi
    assert syn.filter("age IS NULL OR stroke IS NULL OR gender IS NULL").count() == 0   # no spurious nulls
    assert syn.filter("bmi IS NULL").count() > 0                                         # nulls survive
    real_sd = cohort.agg(F.stddev("age")).first()[0]
    assert syn.agg(F.stddev("age")).first()[0] > 0.3 * real_sd


def test_cart_column_order_and_visit_order_effect(cohort, cohort_spec):
    from tabtwin.operators.generate_cart import generate_cart
    from health_table import STROKE_VISIT_ORDER
    small = cohort.filter("rid < 200")
    a = generate_cart(small, cohort_spec, list(STROKE_VISIT_ORDER), 24, key="rid")
    b = generate_cart(small, cohort_spec, list(reversed(STROKE_VISIT_ORDER)), 24, key="rid")
    assert a.columns == small.columns == b.columns
    assert a.dtypes == small.dtypes
    assert a.count() == 200
    assert sorted(a.collect()) != sorted(b.collect())
    levels = {r[0] for r in small.select("work_type").distinct().collect()}
    assert {r[0] for r in a.select("work_type").distinct().collect()} <= levels
