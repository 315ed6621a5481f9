"""Reduced matrices against numpy."""

import numpy as np
import pytest

from tessera.dataset import CountDataset
from tessera.operators import model as M
from tessera.operators import pairs as P
from tessera.operators import raw as R
from tessera.operators import scores as S


@pytest.fixture(scope="module")
def fit(spark):
    # fixed values: two profiles of counts that alternate over the cells
    kinds = (1, 0, 4, 2, 11, 0, 6, 7, 0, 9), (10, 8, 0, 0, 0, 3, 0, 0, 2, 0)
    rows = [(g, c, kinds[i % 2][j] + (i * j) % 3) for i, c in enumerate("abcdefghijklmnopqrst") for j, g in enumerate("ABCDEFGHIJ")]
    return M.estimate_dispersion(M.estimate_nu(M.estimate_lambda(CountDataset.build(spark.createDataFrame(rows, "gene string, cell string, n long")))), 1e-8)


@pytest.mark.parametrize("stored", [False, True])
def test_reduced_matrix_by_definition(fit, stored):
    """Principal components and COEX projections against numpy, over several slices of the Gram matrix."""
    names = [r["gene"] for r in fit.genes.orderBy("pos").collect()]
    cells = [r["cell"] for r in fit.cells.orderBy("cell").collect()]
    x = S.matrix_of(R.data_matrix(fit, "NuNorm"), "cell", "gene", "value", cells, names)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    got = {r["cell"]: r["values"] for r in S.reduced_matrix(fit, method="NuNorm", components=2, genes="all").collect()}
    var = np.sort(np.linalg.eigvalsh(z.T @ z / (len(cells) - 1)))[::-1][:2]
    assert np.array([got[c] for c in cells]).var(0, ddof=1) == pytest.approx(var, rel=1e-9)
    ds = P.calculate_coex(fit) if stored else fit
    rows = P.symmetric(P.coex(fit), "coex").toPandas()
    c = S.matrix_of(fit.spark.createDataFrame(rows), "x1", "x2", "coex", names, names)
    assert S.coex_matrix(ds) == pytest.approx(c, abs=1e-12) and np.abs(c - c.T).max() < 1e-12
    lam = np.linalg.eigh(c)
    v = x @ lam[1][:, np.argsort(-np.abs(lam[0]))[:2]]
    want = np.abs(v) / np.sqrt((v * v).sum(1, keepdims=True))
    got = {r["cell"]: r["values"] for r in S.reduced_matrix(ds, use_coex=True, method="NuNorm", components=2).collect()}
    assert np.abs(np.array([got[k] for k in cells])) == pytest.approx(want, abs=1e-7)


def test_gram_in_slices(fit, monkeypatch):
    monkeypatch.setattr(S, "GRAM_ROWS", 3)
    a = {r["cell"]: r["values"] for r in S.reduced_matrix(fit, method="NuNorm", components=2, genes="all").collect()}
    monkeypatch.undo()
    b = {r["cell"]: r["values"] for r in S.reduced_matrix(fit, method="NuNorm", components=2, genes="all").collect()}
    assert np.abs(np.array([a[k] for k in sorted(a)])) == pytest.approx(np.abs(np.array([b[k] for k in sorted(a)])), abs=1e-9)
