"""Parts of a neighbour graph that no link joins."""

import numpy as np

from tessera.algos.communities import linked, louvain, nearest, shared_graph


def test_linked_parts():
    assert linked([{2: 1.0}, {}, {0: 1.0, 3: 0.5}, {2: 0.5}, {5: 1.0}, {4: 1.0}]).tolist() == [0, 1, 0, 0, 2, 2] and len(linked([])) == 0


def test_uniform_parts_stay_whole(spark, monkeypatch):
    """Communities that noise picks out of a uniform kind don't hide the kind, though none of them is uniform."""
    from tessera.plans import pipelines
    from tessera.queries.more import planted

    ds, halves = planted(spark, "/root/testdata/sf0.01")
    cells = sorted(r.cell for r in ds.cells.collect())
    rng = np.random.default_rng(7)
    points = np.c_[100.0 * np.array([c % 2 for c in cells]), rng.normal(size=len(cells))]
    monkeypatch.setattr(pipelines, "reduced_matrix", lambda *a, **o: spark.createDataFrame([(c, p.tolist()) for c, p in zip(cells, points, strict=True)], "cell long, values array<double>"))
    monkeypatch.setattr(pipelines, "louvain", lambda graph, r: np.arange(len(graph)) % 2)
    real, asked = pipelines.check_uniformity, []

    def check(ds, part, checker, name="", *a, **o):
        asked.append(name)
        done = real(ds, part, checker, name, *a, **o)
        return done if part.count() == 50 else pipelines.replace(done, is_uniform=False)

    monkeypatch.setattr(pipelines, "check_uniformity", check)
    found, _, checks = pipelines.uniform_clusters(ds, gdi_threshold=2.0, minimum_size=20)
    both = found.selectExpr("cluster", "cell % 2 AS kind").distinct().collect()
    assert len(both) == 2 and "-1" not in {r.cluster for r in both} and all(c.is_uniform and c.cluster_size == 50 for c in checks.values())
    assert sorted(asked) == ["01_whole0000", "01_whole0001"], "what was checked as a part is not checked again"
    labels = louvain(shared_graph(nearest(points, 20)), 0.8)
    assert labels.max() + 1 >= 2


def test_dense_rows_come_in_runs(spark):
    """A task's rows are gene by gene, cells of one efficiency side by side: what is written is mostly runs."""
    from tessera.dataset import CountDataset
    from tessera.operators import model as M
    from tessera.operators import raw as R

    rows = [(g, c, 1 + (g + c) % 2 + 3 * (c % 2)) for c in range(12) for g in range(10) if (g + c) % 3]
    ds = M.estimate_nu(M.estimate_lambda(CountDataset.build(spark.createDataFrame(rows, "gene long, cell long, n long"))))
    ds = ds.with_gene_columns(ds.genes.selectExpr("gene", "0.5 AS dispersion"))
    nu = {r.cell: r.nu for r in ds.cells.collect()}
    p0 = {(r.gene, r.cell): (r.p0, r.z) for r in R.probabilities(ds).collect()}
    for made, name in ((M.mu(ds, 6), "mu"), (R.likelihood(ds, "der", 5), "value"), (R.data_matrix(ds, "AdjBin", 5), "value")):
        tasks = [t for t in made.rdd.glom().collect() if t]
        assert sum(map(len, tasks)) == 120 and len({(r.gene, r.cell) for t in tasks for r in t}) == 120
        for t in tasks:
            assert sum(a.gene != b.gene for a, b in zip(t, t[1:])) == 9
            assert all(nu[a.cell] <= nu[b.cell] for a, b in zip(t, t[1:]) if a.gene == b.gene)
    for r in R.data_matrix(ds, "AdjBin", 5).collect():
        p, z = p0[r.gene, r.cell]
        assert abs(r.value - round(p if z else 1 - p, 5)) < 1.1e-5


def test_pdi_without_a_join(spark):
    """Pairs are picked where their statistic is made."""
    from tessera.operators import pairs as P
    from tessera.queries.more import planted

    ds, _ = planted(spark, "/root/testdata/sf0.01")
    for kind in "SG":
        keep = P.statistic(ds, kind).where("x1 <> x2 AND s > 0.01").select("x1", "x2")
        want = {(r.x1, r.x2): r.pdi for r in P.pdi(ds, kind).join(keep, ["x1", "x2"]).collect()}
        made = P.pdi(ds, kind, above=0.01)
        got = {(r.x1, r.x2): r.pdi for r in made.collect()}
        assert set(got) == set(want) and 0 < len(got) < 40 * 39
        assert all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in got)
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()


def test_packed_positions_are_computed(spark):
    """Every place of a triangle gives its row and column back, the last ones of a wide triangle too, without a grid."""
    from tessera.operators import pairs as P

    for n in (1, 2, 7, 60):
        names = spark.range(n).selectExpr("concat('g', id) AS name", "id AS pos")
        vector = spark.range(-2, n * (n + 1) // 2 + 3).selectExpr("id AS position", "double(id) AS value")
        got = {(r.x1, r.x2): r.value for r in P.unpack(vector, names).collect()}
        assert got == {(f"g{i}", f"g{j}"): float(j * n - j * (j - 1) // 2 + i - j) for j in range(n) for i in range(j, n)}
    n = 150_000
    ends = [(i, j) for j in (0, 1, 74_999, 149_997, 149_998, 149_999) for i in {j, j + 1, n - 1} if j <= i < n]
    vector = spark.createDataFrame([(j * n - j * (j - 1) // 2 + i - j, 1.0) for i, j in ends], "position long, value double")
    made = P.unpack(vector, spark.range(n).selectExpr("id AS name", "id AS pos"))
    assert sorted((r.x1, r.x2) for r in made.collect()) == sorted(ends)
    assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString()
