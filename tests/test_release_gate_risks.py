from tabtwin.plans import catalog
from tabtwin.sources import fixtures as fx

DATA = "/root/testdata/sf0.001"


def test_gate_holds_every_risk_against_its_baseline(spark):
    """The whole query, with no part replaced."""
    rows = {r.metric: r for r in catalog.QUERIES["release_gate"](spark, DATA).collect()}
    secrets = {f"inference_{s}_risk" for s in fx.COHORT_ROLES.secrets}
    assert set(rows) == secrets | {"singling_out_univariate_risk", "singling_out_multivariate_risk", "linkability_risk",
                                   "dcr_overfitting_risk", "dcr_baseline_risk", "__release__"}
    risks = [r for m, r in rows.items() if m != "__release__"]
    assert all(0 <= r.value <= 1 and 0 <= r.baseline <= 1 and r.passed == (r.value <= r.baseline) for r in risks)
    assert rows["__release__"].passed == all(r.passed for r in risks)


def test_gate_fails_on_one_risk(spark):
    from tabtwin.operators.privacy import release_gate
    frame = lambda rows: spark.createDataFrame(rows, "metric string, value double")
    got = {r.metric: r.passed for r in release_gate(frame([("a", 0.1), ("b", 0.5), ("c", None)]), frame([("a", 0.1), ("b", 0.4), ("c", 0.1)])).collect()}
    assert got == {"a": True, "b": False, "c": False, "__release__": False}
