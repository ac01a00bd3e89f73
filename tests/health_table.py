"""The declared contract of the health table that several tests use."""

from tabtwin.spec import ColumnSpec, PlausibilityRule

# Columns, rules, bounds and visit order of the health table.
STROKE_COLUMNS = ColumnSpec(
    numeric=("age", "avg_glucose_level", "bmi"),
    binary=("hypertension", "heart_disease", "stroke"),
    categorical=("gender", "ever_married", "work_type", "Residence_type", "smoking_status"),
)
STROKE_PLAUSIBILITY = (
    PlausibilityRule("age_out_of_range", "age < 0 OR age > 120", ("age",)),
    PlausibilityRule("bmi_out_of_range", "bmi <= 0 OR bmi > 100", ("bmi",)),
    PlausibilityRule("glucose_non_positive", "avg_glucose_level <= 0", ("avg_glucose_level",)),
    PlausibilityRule("married_child", "age < 16 AND ever_married = 'Yes'", ("age", "ever_married")),
    PlausibilityRule("adult_labelled_children", "age > 18 AND work_type = 'children'", ("age", "work_type")),
)
STROKE_DP_BOUNDS = {"age": (0.0, 100.0), "avg_glucose_level": (40.0, 300.0), "bmi": (10.0, 100.0)}
STROKE_VISIT_ORDER = ("gender", "age", "hypertension", "ever_married", "work_type", "Residence_type",
                      "avg_glucose_level", "bmi", "smoking_status", "heart_disease", "stroke")
