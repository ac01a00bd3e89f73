import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from tabtwin.session import use_local_checkpoints
    s = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    use_local_checkpoints(s)
    yield s


@pytest.fixture(scope="session")
def cohort_spec():
    from health_table import STROKE_COLUMNS
    return STROKE_COLUMNS


@pytest.fixture(scope="session")
def cohort_rows():
    """400 made-up patients: age groups with their own glucose and weight levels, habits that follow age, every 19th bmi missing."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        group = i % 4                                   # young to old
        age = float(np.clip(14 + 20 * group + rng.gamma(4, 2.5), 14, 92).round(1))
        glucose = float(np.clip(rng.lognormal(4.5 + 0.07 * group, 0.18), 55, 260))
        bmi = None if i % 19 == 3 else float(np.clip(21 + 2 * np.sqrt(group) + rng.normal(0, 3.5), 14, 55))
        pressure, heart, stroke = (int(rng.random() < p) for p in (0.03 + 0.06 * group, 0.01 + 0.03 * group, 0.02 + 0.03 * group))
        adult = group > 0
        rows.append((i, age, glucose, bmi, pressure, heart, stroke, ("Female", "Male")[int(rng.random() < 0.45)],
                     ("No", "Yes")[int(adult and rng.random() < 0.7)], ("Private", "Self-employed", "Govt_job")[int(rng.integers(0, 3))] if adult else "children",
                     ("Rural", "Urban")[i // 7 % 2], ("never smoked", "formerly smoked", "smokes")[int(rng.integers(0, 1 + adult * 2))]))
    return rows


COHORT_SCHEMA = ("rid long, age double, avg_glucose_level double, bmi double, hypertension int, heart_disease int, "
                 "stroke int, gender string, ever_married string, work_type string, Residence_type string, "
                 "smoking_status string")


@pytest.fixture(scope="session")
def cohort(spark, cohort_rows):
    return spark.createDataFrame(cohort_rows, COHORT_SCHEMA)
