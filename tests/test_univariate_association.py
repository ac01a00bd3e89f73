"""Distances and associations against plain numpy over tables with shifts, ties, rare levels and missing values."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from tabtwin.operators.association import association_diff, association_matrix, association_pairs, compare_associations, cramers_v_pairs
from tabtwin.operators.ordered import below, modes, range_sums
from tabtwin.operators.univariate import univariate_fidelity, univariate_summary
from tabtwin.spec import ColumnSpec

SPEC = ColumnSpec(numeric=("load", "heat"), binary=("open",), categorical=("zone", "crew"))
SCHEMA = "load double, heat double, open int, zone string, crew string"


def plant(n, seed, drift):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        zone = "NESW"[int(rng.integers(0, 4))] if rng.random() > 0.08 else None
        load = None if rng.random() < 0.1 else float(rng.poisson(6 + drift))
        heat = float(round(rng.normal(20 + 3 * (zone == "N") + drift, 2), 1))
        out.append((load, heat, int(rng.random() < 0.2 + 0.1 * drift), zone, ("day", "night", "rest")[int(rng.integers(0, 3)) if zone != "S" else 1]))
    return out


@pytest.fixture(scope="module")
def sides(spark):
    a, b = plant(500, 1, 0), plant(300, 2, 1)
    return a, b, spark.createDataFrame(a, SCHEMA).repartition(3), spark.createDataFrame(b, SCHEMA).repartition(5)


def column(rows, name):
    return [r[SCHEMA.replace(",", "").split()[::2].index(name)] for r in rows]


def shares(x, y):
    cx, cy = Counter(x), Counter(y)
    return [(cx[k] / len(x), cy[k] / len(y)) for k in cx.keys() | cy.keys()]


def test_distances_equal_numpy(sides):
    a, b, real, synthetic = sides
    got = {r.column_name: r for r in univariate_fidelity(real, synthetic, SPEC).collect()}
    for name in SPEC.discrete:
        both = shares(column(a, name), column(b, name))
        assert got[name].tvd == pytest.approx(sum(abs(p - q) for p, q in both) / 2)
        assert got[name].hellinger_distance == pytest.approx(math.sqrt(sum((math.sqrt(p) - math.sqrt(q)) ** 2 for p, q in both) / 2))
    for name in SPEC.numeric:
        x, y = (np.array([v for v in column(t, name) if v is not None]) for t in (a, b))
        at = np.unique(np.concatenate([x, y]))
        assert got[name].ks_distance == pytest.approx(max(abs((x <= v).mean() - (y <= v).mean()) for v in at))
    same = univariate_summary(univariate_fidelity(real, real, SPEC)).first()
    assert all(v == pytest.approx(0, abs=1e-12) for v in same)


def eta(levels, values):
    pairs = [(z, v) for z, v in zip(levels, values) if z is not None and v is not None]
    v = np.array([p[1] for p in pairs])
    groups = [v[[p[0] == z for p in pairs]] for z in {p[0] for p in pairs}]
    return math.sqrt(sum(len(g) * (g.mean() - v.mean()) ** 2 for g in groups) / ((v - v.mean()) ** 2).sum())


def cramer(x, y):
    cells, cx, cy, n = Counter(zip(x, y)), Counter(x), Counter(y), len(x)
    chi = sum((cells[i, j] - cx[i] * cy[j] / n) ** 2 / (cx[i] * cy[j] / n) for i, j in itertools.product(cx, cy))
    return math.sqrt(chi / n / (min(len(cx), len(cy)) - 1))


def brute(rows):
    out = {}
    for p, q in itertools.combinations([*SPEC.numeric, *SPEC.binary, *SPEC.categorical], 2):
        x, y = column(rows, p), column(rows, q)
        if q in SPEC.numeric:
            both = np.array([(u, v) for u, v in zip(x, y) if u is not None and v is not None])
            out[p, q] = abs(np.corrcoef(both.T)[0, 1])
        else:
            out[p, q] = eta(y, x) if p in SPEC.numeric else cramer(x, y)
    return out


def test_associations_of_both_sides_equal_numpy(sides):
    a, b, real, synthetic = sides
    want = brute(a), brute(b)
    got = {(r.col_a, r.col_b): r for r in compare_associations(real, synthetic, SPEC).collect()}
    assert got.keys() == want[0].keys()
    for pair, r in got.items():
        assert (r.real, r.synthetic) == (pytest.approx(want[0][pair]), pytest.approx(want[1][pair]))
    alone = {(r.col_a, r.col_b): r.value for r in association_pairs(real, SPEC).collect()}
    assert alone == {p: pytest.approx(v) for p, v in want[0].items()}
    whole = {(r.col_a, r.col_b): r.value for r in association_matrix(real, SPEC).collect()}
    assert len(whole) == 25 and all(whole[q, p] == whole[p, q] for p, q in whole) and all(whole[c, c] == 1 for c in SPEC.all_columns)
    cells = {(r.col_a, r.col_b): r.abs_diff for r in association_diff(real, synthetic, SPEC).collect()}
    assert len(cells) == 25 and all(cells[p] == pytest.approx(abs(want[0][p] - want[1][p])) for p in want[0])


def test_columns_without_variation_associate_with_nothing(spark):
    df = spark.createDataFrame([(5.0, float(i), 1, "only", "ab"[i % 2]) for i in range(30)], SCHEMA)
    got = {(r.col_a, r.col_b): r.value for r in association_pairs(df, SPEC).collect()}
    assert all(v == 0 for (p, q), v in got.items() if {p, q} & {"load", "open", "zone"})
    dropped = cramers_v_pairs(spark.createDataFrame([("x", None), ("x", "u"), ("y", "v")], "p string, q string"), [("p", "q")], dropna=True)
    assert dropped.first().value == pytest.approx(1)


def test_order_helpers(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 5.0], v) for v in (0.0, 1.0, 2.0, 3.0, 9.0, None)], "b array<double>, v double")
    from pyspark.sql import functions as F
    assert [r.n for r in df.select(below(F.col("b"), F.col("v"), 4).alias("n")).collect()] == [0, 0, 1, 3, 4, None]
    votes = spark.createDataFrame([("b", 10), ("a", 9), ("b", 9), ("a", 10), (None, None), (None, None), (None, None)], "s string, k int")
    assert {r.column_name: r["mode"] for r in modes(votes, ["s", "k"]).collect()} == {"s": "a", "k": "9"}
    levels = spark.createDataFrame([(g, v, n) for g in "pq" for v, n in ((None, 4), ("b", 1), ("a", 2), ("c", 3))], "g string, v string, n long")
    assert {(r.g, r.v): r.upto for r in range_sums(levels, ["g"], "v", "n", "upto").collect()} == {(g, v): n for g in "pq" for v, n in ((None, 0), ("a", 4), ("b", 6), ("c", 7))}
