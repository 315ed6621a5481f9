"""What larger tables need: small shuffles, joins of what is asked for alone, and little memory on the driver."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.dataset import CountDataset
from tessera.operators import model as M


@pytest.fixture(scope="module")
def fit(spark):
    # fixed values: two profiles of counts that alternate over the cells
    kinds = (1, 0, 4, 2, 11, 0, 6, 7, 0, 9), (10, 8, 0, 0, 0, 3, 0, 0, 2, 0)
    rows = [(g, c, kinds[i % 2][j]) for i, c in enumerate("abcdefghijklmnopqrst") for j, g in enumerate("ABCDEFGHIJ")]
    return M.estimate_dispersion(M.estimate_nu(M.estimate_lambda(CountDataset.build(spark.createDataFrame(rows, "gene string, cell string, n long")))), 1e-8)


def test_observed_pairs_are_sent_as_gaps():
    """Tiles give each pair back as often as cells hold it, and take little more than half of four bytes a pair."""
    from tessera.operators import dense

    n, height, rng = 3000, 100, np.random.default_rng(3)
    lists = [np.sort(rng.choice(n, 30, replace=False)).astype(np.int32) for _ in range(2000)]
    want = np.zeros((n, n), int)
    for own in lists:
        want[own[:, None], own[None]] += 1
    got, sent = np.zeros((n, n), int), 0
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], ["own"])
    for tiles in dense._pair_codes(n, height, True)(iter([batch])):
        for strip, data in zip(tiles.column("strip").to_pylist(), tiles.column("data").to_pylist(), strict=True):
            code, k = dense._joined(np.frombuffer(data, np.uint32))
            got[strip * height + code // n, code % n] += k
            sent += pa.compress(data, "lz4").size
    assert (got == want).all() and sent < 0.6 * 4 * want.sum()


def test_blocks_make_only_pairs_that_they_show(fit, monkeypatch):
    from tessera.operators import pairs as P
    from tessera.operators import plotdata as V

    full = {(r.x1, r.x2): r.coex for r in P.coex(fit, subset=["B", "C"]).collect()}
    part = {(r.x1, r.x2): r.coex for r in P.coex(fit, subset=["B", "C"], rows_of=["B", "D"]).collect()}
    assert set(part) == {(a, b) for a in "BD" for b in "BC"} and all(part[k] == pytest.approx(full[k], abs=1e-12) for k in part)
    made = []
    monkeypatch.setattr(V, "coex", lambda ds, **k: made.append(P.coex(ds, **k)) or made[-1])
    blocks, limits = V.genes_blocks(fit, ["B"], ["C"], 0.05)
    rows = blocks.collect()
    assert {(r.x1, r.x2) for r in rows} == {(r.x1, r.x2) for r in made[-1].collect()}
    assert limits == pytest.approx([round(float(np.quantile([r.coex for r in rows], q)), 3) for q in (0.001, 0.999)], abs=1e-9)


def test_distances_are_held_once():
    """The same merges as from a square matrix, within the memory of a triangle and a few rows."""
    import tracemalloc

    from tessera.algos.hierarchy import Distances, linkage

    x = np.random.default_rng(4).normal(size=(2000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = linkage(1 - x @ x.T)
    tracemalloc.start()
    got = linkage(Distances.cosine(x))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [m[:2] for m in got] == [m[:2] for m in want] and [m[2] for m in got] == pytest.approx([m[2] for m in want])
    assert peak < 8 * 2000 * 2000


def test_dense_rows_once_for_each_efficiency(fit, monkeypatch):
    """Rows are rounded where they are made, in slices and with few kept efficiencies as at once."""
    from tessera.operators import raw as R

    mu = {(r.gene, r.cell): r.mu for r in fit.genes.crossJoin(fit.cells).selectExpr("gene", "cell", "round(lambda * nu, 6) AS mu").collect()}
    logs = {(r.gene, r.cell): r.value for r in R.likelihood(fit, "sLog").collect()}
    monkeypatch.setattr(R, "DENSE_VALUES", 25)
    monkeypatch.setattr(R, "DENSE_KEPT", 15)
    assert {(r.gene, r.cell): pytest.approx(r.mu, abs=1e-12) for r in M.mu(fit, 6).collect()} == mu and len(mu) == 200
    assert {(r.gene, r.cell): pytest.approx(r.value, abs=6e-6) for r in R.likelihood(fit, "sLog", 5).collect()} == logs
    assert R.rounded(np.array([-2.5, 0.125, -0.001]), 2).tolist() == [-2.5, 0.13, 0.0] and np.signbit(R.rounded(np.array([-0.001]), 2)).sum() == 0
    for rows in (M.mu(fit, 6), R.likelihood(fit, "sLog", 5)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "round(" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_stored_coex_is_packed(fit, monkeypatch):
    """What is written out has a row a gene, and reads as the table of pairs."""
    from tessera.operators import pairs as P

    want = {(r.x1, r.x2): r.coex for r in P.coex(fit).collect()}
    written, keep = [], P.checkpoint
    monkeypatch.setattr(P, "checkpoint", lambda rows: written.append(keep(rows)) or written[-1])
    monkeypatch.setattr(P, "UNPACKED", 4)
    rows = P.calculate_coex(fit).gene_coex.collect()
    assert [len(w.columns) for w in written] == [2] and written[0].count() == 10
    assert len(rows) == len(want) == 55 and {(r.x1, r.x2): pytest.approx(r.coex, abs=1e-12) for r in rows} == want
