"""Chebyshev nodes in place of many distinct efficiencies."""

import numpy as np
import pytest

from tessera.algos.solvers import zero_probability
from tessera.operators import model as M

INF = float("inf")


def test_few_nodes_stand_for_many_efficiencies():
    """Sums of products of zero probabilities over the nodes are those over all efficiencies."""
    rng = np.random.default_rng(5)
    nu = np.unique(np.r_[0.0, rng.lognormal(0, 1.2, 20_000)])
    m = rng.integers(1, 4, len(nu)).astype(float)
    few, w = M.nodes(nu, m)
    assert len(few) < 1500 and few[0] == 0.0 and w.sum() == pytest.approx(m.sum(), rel=1e-13)
    a = np.array([-INF, -200.0, -3.0, 0.0, 1e-5, 0.01, 0.7, 5.0, 900.0])
    lam = np.array([1.0, 0.02, 3.0, 0.5, 40.0, 1e-4, 2.0, 0.3, 8.0])
    whole, small = (zero_probability(a[:, None], lam[:, None] * x[None]) for x in (nu, few))
    assert np.abs((whole * m) @ whole.T - (small * w) @ small.T).max() < 1e-11 * m.sum()
    assert np.abs(whole @ m - small @ w).max() < 1e-11 * m.sum()
    same, kept = M.nodes(nu[:40], m[:40])
    assert (same == nu[:40]).all() and (kept == m[:40]).all(), "few efficiencies stay as they are"
