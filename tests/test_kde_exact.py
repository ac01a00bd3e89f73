"""KDE curves are the exact sums over all values."""

import math

import numpy as np

from tabtwin.operators.profile import kde_table


def test_density_is_the_exact_sum(spark):
    rng = np.random.default_rng(3)
    real = [(float(x),) for x in np.concatenate([rng.normal(10, 2, 300).round(2), [40.0, 40.0]])] + [(None,)]
    synth = [(float(x),) for x in rng.gamma(3, 4, 200)]
    got = kde_table(*(spark.createDataFrame(rows, "a double") for rows in (real, synth)), ["a"], grid_size=30).collect()
    assert len(got) == 60 and "error_bound" not in got[0].asDict()
    sides = {"real": np.array([v for v, in real if v is not None]), "synthetic": np.array([v for v, in synth])}
    h = {s: v.std(ddof=1) * len(v) ** -0.2 for s, v in sides.items()}
    grid = np.linspace(min(v.min() for v in sides.values()) - 3 * max(h.values()), max(v.max() for v in sides.values()) + 3 * max(h.values()), 30)
    for r in got:
        z = (grid[r.grid_index] - sides[r.side]) / h[r.side]
        exact = np.exp(-0.5 * z * z).sum() / (len(z) * h[r.side] * math.sqrt(2 * math.pi))
        assert math.isclose(r.x, grid[r.grid_index], rel_tol=1e-12) and math.isclose(r.density, exact, rel_tol=1e-9)
