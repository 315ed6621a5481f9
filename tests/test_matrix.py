"""Constants, definitions and invariants of the count-matrix operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.algos.communities import louvain, nearest, shared_graph
from tessera.algos.hierarchy import cut_tree, leaf_order, linkage
from tessera.algos.solvers import dispersion_bisection, dispersion_newton, nu_bisection, zero_probability
from tessera.dataset import CountDataset
from tessera.functions.special import chi_square_tail, erfc, probability_of_zero
from tessera.operators import clusters as C
from tessera.operators import labels as L
from tessera.operators import model as M
from tessera.operators import pairs as P
from tessera.operators import raw as R
from tessera.operators import scores as S
from tessera.operators import uniformity as U
from tessera.sources import tables as T

INF = float("inf")
#: Two profiles of counts that alternate over the cells.
ODD, EVEN = (1, 0, 4, 2, 11, 0, 6, 7, 0, 9), (10, 8, 0, 0, 0, 3, 0, 0, 2, 0)


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(g, c, (ODD if i % 2 == 0 else EVEN)[j]) for i, c in enumerate("abcdefghijklmnopqrst") for j, g in enumerate("ABCDEFGHIJ")]
    return CountDataset.build(spark.createDataFrame(rows, "gene string, cell string, n long"))


@pytest.fixture(scope="module")
def fit(tiny):
    return M.estimate_dispersion(M.estimate_nu(M.estimate_lambda(tiny)), 1e-8)


def test_solver_constants():
    # fixed values: known solutions of the zero-count equations
    nu = np.tile([0.5, 1.5], 5)
    assert dispersion_newton([3, 1.75, 2], [0, 5, 1], nu) == pytest.approx([-INF, 1.980664643877, -0.645937418860], abs=1e-11)
    assert dispersion_bisection([3, 1.75, 2], [0, 5, 1], nu) == pytest.approx([-INF, 1.980468750, -0.646484375])
    lam, a = [5.5, 4, 2, 1, 5.5, 1.5, 3, 3.5, 1, 4.5], [-INF, 4, 2.5, 0.9, 5, 1.9, 3.5, 4, 0.9, 4.5]
    assert nu_bisection([3, 6], lam, a, [1.0, 1.5]) == pytest.approx([3.1484375, 0.349365234375])


def test_solvers_end_where_rounding_hides_the_threshold():
    # sums over 1.2 million cells are rounded by more than 1e-10: both ways still end, near one another
    nu, m = np.arange(11, 53) / 30, np.round(1.2e6 * np.exp(-((np.arange(42) - 19) ** 2) / 60) / 13.7)
    lam = np.linspace(4e-4, 6e-4, 200)
    zeros = np.round(m.sum() - lam * (m * nu).sum() * np.linspace(0.97, 1.0, 200))
    found = dispersion_bisection(lam, zeros, nu, m, 1e-10)
    assert np.isfinite(found).all() and np.abs(zero_probability(found[:, None], lam[:, None] * nu) @ m - zeros).max() < 2e-9
    quick = dispersion_newton(lam, zeros, nu, m, 1e-10, strict=False)
    ok = ~np.isnan(quick)
    assert ok.any() and np.abs(quick - found)[ok].max() < 1e-6


def test_zero_probability(spark):
    cases = [(-1.0, 1.0, math.exp(-2)), (0.0, 1.0, math.exp(-1)), (1.0, 1.0, 0.5), (10.0, 1.0, 11**-0.1), (INF, 1.0, 1.0), (-INF, 1.0, 0.0)]
    df = spark.createDataFrame(cases, "a double, mu double, want double").select(probability_of_zero(F.col("a"), F.col("mu")).alias("p"), "*")
    for r in df.collect():
        assert r.p == pytest.approx(r.want) and zero_probability(r.a, r.mu) == pytest.approx(r.want)


def test_erfc(spark):
    x = [0.001, 0.3, 1.0, 1.999, 2.0, 3.5, 10.0, 25.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", erfc(F.col("x")).alias("y"), chi_square_tail(F.lit(0.0)).alias("one")).collect()
    assert all(r.y == pytest.approx(math.erfc(r.x), rel=1e-12) and r.one == 1 for r in got)


def test_sizes(tiny):
    assert (tiny.n_genes, tiny.n_cells) == (10, 20)
    assert {r.n_genes for r in R.expressed_genes(tiny).collect()} == {7, 4}
    assert [r.n_cells for r in R.expressing_cells(tiny).orderBy("pos").collect()] == [20] + [10] * 9
    flagged = R.flag_fully_expressed(tiny)
    assert [r.gene for r in flagged.genes.where("fe_genes").collect()] == ["A"]


def test_model_marginals(fit):
    rows = M.expected_zeros(fit).join(R.expressing_cells(fit), "gene").collect()
    assert all(r.zeros == pytest.approx(20 - r.n_cells, abs=1e-6) for r in rows)
    assert fit.genes.where("gene = 'A'").first()["dispersion"] == -INF


def test_coex(fit):
    pairs = {(r.x1, r.x2): r.coex for r in P.coex(fit).collect()}
    assert len(pairs) == 55
    assert all(abs(v) < 1e-4 if "A" in k else 0.95 < abs(v) < 1.05 for k, v in pairs.items())
    assert P.small_expected_fraction(fit).first()["fraction"] == pytest.approx(10 / 55)
    part = {(r.x1, r.x2): r.coex for r in P.coex(fit, subset=["C", "E"]).collect()}
    assert len(part) == 20 and all(v == pytest.approx(pairs[min(k), max(k)]) for k, v in part.items())


def test_strips_as_the_joined_tables(fit, monkeypatch):
    from tessera.operators import dense

    both = P.both_tables(fit).select("x1", "x2", P.coex_value(20).alias("coex"))
    want = {(r.x1, r.x2): r.coex for r in both.collect()}
    s = P.symmetric(both, "coex").select("x1", "x2", F.when(F.col("x1") == F.col("x2"), 0.0).otherwise(F.col("coex") * F.col("coex") * 20).alias("s"))
    scores = {r.x2: r.gdi for r in S.gdi_given_s(s, 10, 0.3).collect()}
    for per_pair in (1e-7, 1.0):  # by pairs of lists, and by products of small blocks and chunks
        monkeypatch.setattr(dense, "PER_PAIR", per_pair)
        monkeypatch.setattr(dense, "BLOCK", 4)
        monkeypatch.setattr(dense, "CHUNK", 3)
        monkeypatch.setattr(dense, "OUT", 3)
        assert {(r.x1, r.x2): pytest.approx(r.coex, abs=1e-9) for r in P.coex(fit).collect()} == want
        assert {r.gene: pytest.approx(r.gdi, abs=1e-6) for r in S.gdi(fit, fraction=0.3).collect()} == scores
        g = {(r.x1, r.x2): r.s for r in P.g_statistic(fit).collect()}
        assert len(g) == 100 and all(g[k] == pytest.approx(g[k[::-1]], abs=1e-6) for k in g)
        assert "SortMergeJoin" not in P.coex(fit)._jdf.queryExecution().executedPlan().toString().split("FlatMapGroups")[0]


def test_dense_rows_without_a_shuffle_of_the_grid(fit):
    rows = {(r.gene, r.cell): (r.z, r.p0) for r in R.probabilities(fit).collect()}
    for formula in ("raw", "sLog"):
        made = R.likelihood(fit, formula)
        assert made._jdf.queryExecution().executedPlan().toString().count("CartesianProduct") + made._jdf.queryExecution().executedPlan().toString().count("NestedLoop") == 0
        got = {(r.gene, r.cell): r.value for r in made.collect()}
        assert set(got) == set(rows)
        for k, (z, p) in rows.items():
            p = max(min(p, 1 - 1e-8), 1e-8)
            assert got[k] == pytest.approx({"raw": 1 - p if z else p, "sLog": -math.log1p(-p) if z else math.log(p)}[formula], abs=1e-9)
    got = {r.gene: r.ce for r in S.cross_entropy(fit).collect()}
    assert S.cross_entropy(fit)._jdf.queryExecution().analyzed().toString().count("nu") and got["A"] == 0
    for g in set(got) - {"A"}:
        assert got[g] == pytest.approx(-sum(math.log1p(-p) if z else math.log(p) for (x, _), (z, p) in rows.items() if x == g) / 20, abs=1e-9)


def test_tables_sum_to_the_cells(fit):
    for table in (P.observed_tables(fit), P.expected_tables(fit), P.expected_tables(fit, cells=True)):
        n = {round(r.nn + r.ny + r.yn + r.yy, 6) for r in table.collect()}
        assert len(n) == 1 and n <= {20.0, 10.0, 20, 10}
    yy = {(r.x1, r.x2): r.yy for r in P.observed_yy(fit).collect()}
    assert yy["A", "A"] == 20 and yy["B", "B"] == 10


def test_stored_coex_and_sync(fit):
    ds = P.calculate_coex(fit.initialize_metadata("G", "m", "c"), fraction=True)
    assert P.coex_available(ds) and not P.coex_available(ds, cells=True)
    assert P.get_coex(ds).where("x1 = x2 and coex <> 0").count() == 0
    assert not P.coex_available(M.estimate_lambda(ds))
    with pytest.raises(ValueError):
        P.get_coex(M.estimate_lambda(ds))
    assert [r.gene for r in S.selected_genes(ds, "HGDI", 5).collect()] == ["C", "D", "F", "G", "I"]


def test_dea_and_fold_changes(fit, spark):
    clusters = fit.cells.select("cell", (F.col("pos") % 2).cast("string").alias("cluster"))
    rows = {(r.gene, r.cluster): r.coex for r in C.dea(fit, clusters).collect()}
    assert rows["B", "1"] > 0.9 and rows["C", "0"] > 0.9 and abs(rows["A", "0"]) < 1e-6
    lfc = {(r.gene, r.cluster): r.lfc for r in C.log_fold_change(fit, clusters).collect()}
    assert all(lfc[g, "0"] == pytest.approx(-lfc[g, "1"]) for g in "ABCDEFGHIJ")
    markers = C.cluster_markers(fit, clusters, 2)
    assert markers.count() == 8


def test_adjustments(spark):
    p = [0.01, 0.02, 0.03, 0.04, 0.5]
    df = spark.createDataFrame([("c", str(i), v) for i, v in enumerate(p)], "cluster string, gene string, p_value double")
    got = {m: [round(r.p_value, 10) for r in C.adjusted(df, m, 5).orderBy("gene").collect()] for m in C.ADJUSTMENTS}
    assert got["none"] == p and got["bonferroni"] == [0.05, 0.1, 0.15, 0.2, 1.0]
    assert got["holm"] == [0.05, 0.08, 0.09, 0.09, 0.5] and got["hochberg"] == [0.05, 0.08, 0.08, 0.08, 0.5]
    assert got["BH"] == [0.05, 0.05, 0.05, 0.05, 0.5] and got["hommel"][-1] == 0.5
    assert all(a <= b for a, b in zip(got["hommel"], got["hochberg"], strict=True))


def test_labels(spark, tiny):
    clusters = tiny.cells.select("cell", F.concat(F.lit("I"), (F.col("pos") % 3).cast("string")).alias("cluster"))
    back = L.from_lists(L.to_lists(clusters), tiny.cells)
    assert back.exceptAll(clusters).count() == 0
    merged = L.merge_clusters(clusters, ["I2", "I0"])
    assert {r.cluster for r in merged.collect()} == {"I0_I2-merge", "I1"}
    with pytest.warns(UserWarning):
        assert L.merge_clusters(clusters, ["I0", "none"]).exceptAll(clusters).count() == 0
    ds = L.add_labels(tiny, "x", clusters)
    assert L.label_names(ds) == ["x"] and L.get_labels(ds).exceptAll(clusters).count() == 0
    with pytest.raises(ValueError):
        L.add_labels(ds, "x", clusters)
    assert {r.condition for r in L.get_labels(tiny, "", L.CONDITION).collect()} == {L.NO_CONDITION}
    assert L.label_names(L.drop_labels(ds, "x")) == []


def test_validation(spark):
    for bad in ([("a", "b", -1.0)], [("a", "b", 0.5)], [("a", None, 1.0)], [("a", "b", None)]):
        with pytest.raises(ValueError):
            CountDataset.build(spark.createDataFrame(bad, "gene string, cell string, n double"))


def test_drop(tiny):
    part = R.drop_genes_cells(tiny, ["A"], ["a", "b"])
    assert (part.n_genes, part.n_cells) == (9, 18) and part.counts.where("gene = 'A' or cell in ('a', 'b')").count() == 0
    assert R.drop_genes_cells(tiny) is tiny
    with pytest.raises(ValueError):
        R.drop_genes_cells(tiny, ["Z"])


def test_checks(spark):
    gdi = spark.createDataFrame([(1.0 + i / 1000,) for i in range(500)], "gdi double")
    simple = U.SimpleCheck().check(gdi, 70)
    assert not simple.is_uniform and simple.check_.fraction_beyond == pytest.approx(0.2)
    assert U.SimpleCheck(U.GDICheck(gdi_threshold=1.6)).check(gdi, 70).is_uniform
    advanced = U.AdvancedCheck().check(gdi, 70)
    frame = U.checks_to_frame(spark, [advanced])
    assert len(frame.columns) == 35
    assert U.frame_to_checks(frame)[0].fourth.threshold_rank == advanced.fourth.threshold_rank
    assert simple.shifted(0.1).threshold == pytest.approx(1.5)
    with pytest.raises(ValueError):
        U.GDICheck(gdi_threshold=0.9)


def test_round_trips(spark, tiny, tmp_path):
    T.save(tiny, str(tmp_path / "d"))
    assert T.load(spark, str(tmp_path / "d")).counts.exceptAll(tiny.counts).count() == 0
    assert list(T.load_conditions(spark, str(tmp_path), ["d", "missing"])) == ["d"]
    made = T.to_single_cell(tiny)
    again = T.from_single_cell({"counts": made["counts"]}, made["genes"].drop("pos"), made["cells"].drop("pos"))
    assert again.counts.exceptAll(tiny.counts).count() == 0
    (tmp_path / "w.tsv").write_text("g\tc1\tc2\nx\t1\t0\ny\t2\t3\n")
    assert T.read_wide(spark, str(tmp_path / "w.tsv")).counts.count() == 3


def test_trees():
    d = np.abs(np.subtract.outer([0, 1, 10, 11, 50], [0, 1, 10, 11, 50])).astype(float)
    for method in ("ward.D2", "complete", "average", "single"):
        merges = linkage(d, method)
        assert cut_tree(merges, 5, 3).tolist() == [1, 1, 2, 2, 3] and sorted(leaf_order(merges, 5)) == list(range(5))


def test_communities():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0, 5, 10)])
    labels = louvain(shared_graph(nearest(x, 10)), 0.3)
    assert len({*labels[:40]} & {*labels[40:80]}) == 0 and len({*labels[40:80]} & {*labels[80:]}) == 0


def test_entry_without_the_subpackage(tmp_path):
    """The entry imports and the library's queries are there when the optional folders are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'coex' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_uniform_pairs_of_the_first_batch_merge(fit, monkeypatch):
    from dataclasses import replace

    from tessera.plans import pipelines

    monkeypatch.setattr(pipelines, "check_uniformity", lambda ds, cells, checker, *a, **o: replace(checker, check_=replace(checker.check_, quantile_at_ratio=1.0), is_uniform=True, cluster_size=cells.count()))
    labels = fit.cells.select("cell", F.when(F.col("cell") < "k", "a").otherwise("b").alias("cluster"))
    merged, _, checks = pipelines.merge_uniform_clusters(fit, labels, [U.SimpleCheck()])
    assert merged.select("cluster").distinct().count() == 1 and list(checks) == ["a_b-merge"]


def test_documents_keep_the_words_of_one_language(spark, sf):
    from tessera.queries.more import documents, languages

    ds = documents(spark, sf)
    by = ds.counts.join(languages(ds, sf), "cell").groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("cluster") == "es").cast("double")).alias("es"))
    assert by.where("n >= 3 and es >= 0.8").count() > 0


def test_uniform_clusters_resume(spark, tmp_path):
    """Two planted kinds are found; the dumps are there, and a stopped run goes on from them."""
    from tessera.plans import pipelines
    from tessera.queries.more import planted

    ds, halves = planted(spark, "/root/testdata/sf0.01")
    kinds = halves.select("cell", F.substring("cluster", 1, 1).alias("cluster"))
    half = kinds.select("cell", F.when(F.col("cluster") == "0", "a").otherwise(F.concat(F.lit("b"), (F.col("cell") % 3).cast("string"))).alias("cluster"))
    first, _, checks = pipelines.uniform_clusters(ds, gdi_threshold=2.0, minimum_size=20, initial=half, max_iterations=1, save_to=str(tmp_path))
    assert {r.cluster: r["count"] for r in first.groupBy("cluster").count().collect()} == {"-1": 50, "1": 50}
    assert checks["1"].is_uniform and checks["-1"].cluster_size == 50
    steps = tmp_path / "reclustering"
    assert {p.name for p in steps.iterdir()} == {"uniform_cluster_01_a", "partial_clusterization_1", "all_check_results_1"}
    rest = kinds.where("cluster = '1'")
    again, _, checks = pipelines.uniform_clusters(ds, gdi_threshold=2.0, minimum_size=20, initial=rest, initial_iteration=2, resume=True, save_to=str(tmp_path))
    both = again.withColumnRenamed("cluster", "found").join(kinds, "cell").groupBy("found", "cluster").count().collect()
    assert len(both) == 2 and all(r["count"] == 50 for r in both) and all(c.is_uniform for c in checks.values())
    saved = spark.read.csv(str(tmp_path / "split_clusterization"), header=True)
    assert saved.count() == 100 and spark.read.csv(str(tmp_path / "split_check_results"), header=True).count() == 2


def test_merge_goes_on_from_its_dumps(spark, tmp_path, monkeypatch):
    from tessera.plans import pipelines
    from tessera.queries.more import planted

    ds, halves = planted(spark, "/root/testdata/sf0.01")
    calls = []
    real = pipelines.check_uniformity
    monkeypatch.setattr(pipelines, "check_uniformity", lambda *a, **o: calls.append(a[3]) or real(*a, **o))
    checkers = [U.SimpleCheck(U.GDICheck(gdi_threshold=t)) for t in (1.01, 2.0)]
    merged, _, tested = pipelines.merge_uniform_clusters(ds, halves, checkers, save_to=str(tmp_path))
    assert merged.join(halves, "cell").select(merged.cluster, F.substring(halves.cluster, 1, 1)).distinct().count() == 2
    assert len(calls) == len(set(calls)), "a known pair is judged from its quantile"
    clusters, known = pipelines.resumed_merge(ds, str(tmp_path), 1)
    assert clusters.exceptAll(halves).count() == 0 and set(known) <= set(tested)
    calls.clear()
    again, _, _ = pipelines.merge_uniform_clusters(ds, clusters, checkers, previous=known, initial_iteration=2)
    assert again.exceptAll(merged).count() == 0 and not set(calls) & set(known)


def test_reused_checks(spark):
    gdi = spark.createDataFrame([(1.0 + i / 1000,) for i in range(500)], "gdi double")
    for kind in (U.SimpleCheck, U.AdvancedCheck):
        done = kind().check(gdi, 70)
        for shift in (0.0, 0.05, 0.2):
            assert kind().shifted(shift).reusing(done).is_uniform == kind().shifted(shift).check(gdi, 70).is_uniform
        assert kind().reusing(kind()) is None
    other = U.SimpleCheck(U.GDICheck(gdi_threshold=1.2, max_ratio_beyond=0.3))
    assert other.reusing(U.SimpleCheck().check(gdi, 70)) is None


def test_closed_simes_by_all_sets():
    """Adjusted p-values against Simes' test of every set of tests."""
    from itertools import combinations

    from tessera.algos.adjust import closed_simes

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 6, 8):
        for p in (rng.random(n) ** 2, rng.random(n) * 0.05, np.round(rng.random(n), 1)):
            simes = lambda s, p=p: min(len(s) * v / (k + 1) for k, v in enumerate(sorted(p[list(s)])))
            want = [min(1, max(simes(s) for m in range(1, n + 1) for s in combinations(range(n), m) if i in s)) for i in range(n)]
            assert closed_simes(p) == pytest.approx(want)


def test_chains_merge_as_the_closest_pair_does():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for method in ("complete", "single", "average", "ward.D2"):
        groups, heights = [frozenset([i]) for i in range(40)], []

        def gap(a, b, method=method):
            own = d[np.ix_(sorted(a), sorted(b))]
            if method == "ward.D2":
                centre = x[sorted(a)].mean(0) - x[sorted(b)].mean(0)
                return math.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * (centre @ centre))
            return {"complete": own.max(), "single": own.min(), "average": own.mean()}[method]

        while len(groups) > 1:
            h, a, b = min((gap(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i]))
            heights.append(h)
            groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] | groups[b]]
            if len(groups) == 5:
                want = sorted(sorted(g) for g in groups)
        merges = linkage(d, method)
        labels = cut_tree(merges, 40, 5)
        assert [h for _, _, h in merges] == pytest.approx(heights)
        assert sorted(np.flatnonzero(labels == k).tolist() for k in range(1, 6)) == want


def test_joint_fit():
    from tessera.algos.solvers import fit_zeros

    rng = np.random.default_rng(3)
    lam, nu = rng.uniform(0.3, 3, 30), rng.uniform(0.5, 1.5, 50)
    nu /= nu.mean()
    p = zero_probability(rng.uniform(0.2, 2, 30)[:, None], lam[:, None] * nu)
    a, found = fit_zeros(lam, p.sum(1), p.sum(0), np.ones(50), 1e-3, 200)
    q = zero_probability(a[:, None], lam[:, None] * found)
    assert np.abs(q.sum(1) - p.sum(1)).max() < 0.05 and np.abs(q.sum(0) - p.sum(0)).max() < 0.05 and found.mean() == pytest.approx(1, abs=0.01)


def test_label_inputs(spark, tiny):
    lists = spark.createDataFrame([("z", ["a", "b"], 0), ("m", ["b", "c"], 1)], "cluster string, elements array<string>, pos int")
    got = {r.cell: r.cluster for r in L.from_lists(lists, tiny.cells, throw_on_overlap=False).collect()}
    assert (got["a"], got["b"], got["c"], got["d"]) == ("z", "m", "m", "-1")
    with pytest.raises(ValueError):
        L.from_lists(lists)
    half = {c: int(c > "j") for c in "abcdefghijklmnopqrst"}
    name, labels = L.name_and_labels(tiny, labels=half)
    assert name == "DummyName" and {r.cell: r.cluster for r in labels.collect()} == {k: str(v) for k, v in half.items()}
    with pytest.raises(ValueError):
        L.as_clusterization({"a": 1}, tiny)
    ds = L.add_labels(tiny, "x", labels)
    assert L.name_and_labels(ds)[0] == "CL_x" and L.name_and_labels(ds, prefix=L.CONDITION)[0] == L.NO_CONDITION


def test_flags(tiny):
    assert R.not_fully_expressed(tiny).where("not flag").count() == 0
    flagged = R.flag_fully_expressed(tiny)
    assert [r.gene for r in R.fully_expressed(flagged).collect()] == ["A"] and R.fully_expressing(flagged).count() == 0
    assert R.not_fully_expressed(flagged).where("flag").count() == 9
    with pytest.raises(ValueError):
        M.set_estimate(tiny, "lambda", flagged.genes.select(F.lit("A").alias("gene"), F.lit(1.0).alias("lambda")))


def test_clean_plots_and_umap(spark):
    """The planted kinds are the two groups; the components are those of a plain decomposition."""
    from tessera.operators import plotdata as V
    from tessera.queries.more import planted

    ds, halves = planted(spark, "/root/testdata/sf0.01")
    kept = halves.where("cluster not in ('1_0')").select("cell")
    from tessera.plans.pipelines import restricted

    part = M.estimate_nu(restricted(ds, kept))
    out = V.clean_plots(part)
    cells = out["cells"].join(halves, "cell").toPandas().sort_values("cell")
    pcs = cells[[f"pc{i}" for i in range(1, 6)]].to_numpy()
    pcs = (pcs - pcs.mean(0)) / pcs.std(0, ddof=1)
    halves_ = cut_tree(linkage(np.sqrt(((pcs[:, None] - pcs[None]) ** 2).sum(2)), "complete"), len(pcs), 2)
    assert len(set(zip(halves_, cells.groups, strict=True))) == 2 and (cells.groups == "A").sum() >= (cells.groups == "B").sum() > 0
    genes = out["genes"].orderBy("rank").toPandas()
    members = set(cells[cells.groups == "B"].cell)
    value = R.nu_normalised(part).toPandas()
    mean = value[value.cell.isin(members)].assign(value=lambda v: v.value.round(4)).groupby("gene").value.sum() / len(members)
    assert genes["mean"].to_numpy() == pytest.approx(mean[genes.gene].to_numpy()) and genes["mean"].is_monotonic_decreasing and len(genes) == (mean > 0).sum()
    x = R.nu_normalised(part).toPandas().pivot(index="cell", columns="gene", values="value").fillna(0.0).sort_index()
    x = x.to_numpy() - x.to_numpy().mean(0)
    want = np.abs((np.linalg.svd(x, full_matrices=False)[0] * np.linalg.svd(x, full_matrices=False)[1])[:, 0])
    assert np.abs(cells.pc1.to_numpy()) == pytest.approx(want, abs=1e-6)
    points, reduced, title = V.cells_umap(part, clusters=halves.join(kept, "cell", "left_semi"), components=5, genes="HVG_Scanpy", k=30, epochs=50)
    assert points.count() == reduced.count() == part.n_cells and "HVG_Scanpy" in title
    xy = points.toPandas()
    a, b = (xy[xy.cluster.str[0] == k][["x", "y"]].to_numpy() for k in "01")
    assert np.linalg.norm(a.mean(0) - b.mean(0)) > max(a.std(), b.std())


def test_heatmaps(spark, fit, tmp_path):
    from tessera.operators import plotdata as V

    full = R.flag_fully_expressed(fit)
    T.save(full, str(tmp_path / "one"))
    rows = spark.createDataFrame([("A", "t"), ("C", "t"), ("Z", "u")], "gene string, type string")
    got = V.heatmap_of_conditions(spark, str(tmp_path), ["one", "none"], ["B", "C"], rows).collect()
    assert len(got) == 6 and {r.condition for r in got} == {"one"}
    assert {(r.x1, r.absent, r.fe_genes) for r in got} == {("A", False, True), ("C", False, False), ("Z", True, False)}
    with pytest.raises(ValueError):
        V.heatmap_of_conditions(spark, str(tmp_path), ["none"], ["B"], rows)
    blocks, (low, high) = V.genes_blocks(fit, ["B"], ["C"], 0.05)
    seen = {(r.row_marker, r.x1) for r in blocks.collect()}
    assert {m for m, _ in seen} == {"B", "C"} and low <= 0 <= high
    assert {x for m, x in seen if m == "C"} <= set("CDEGHJ") and {x for m, x in seen if m == "B"} <= set("BFI")
    clusters = fit.cells.select("cell", F.concat(F.lit("k"), (F.col("pos") % 2).cast("string")).alias("cluster"))
    groups = spark.createDataFrame([("g", "B"), ("h", "B"), ("h", "C")], "group string, gene string")
    conditions = fit.cells.select("cell", F.when(F.col("pos") < 10, "L").otherwise("H").alias("condition"))
    parts = V.markers_heatmap_parts(fit, groups, clusters, {"half": conditions}, cuts=2)
    assert {r.label for r in parts["cells"].collect()} == {"B", "B_1", "C"} and parts["cells"].count() == 6
    assert {(r.cluster, r.place) for r in parts["tree"].collect()} == {("k0", 0), ("k1", 1)}
    assert {r.cell_number for r in parts["sizes"].collect()} == {10} and all(r.L == 0.5 for r in parts["half"].collect())
    stored = S.store_gdi(fit, S.gdi(fit))
    a, b = (sorted((r.gene, round(r.gdi, 9), round(r.sum_raw_norm, 9)) for r in V.gdi_plot(d).collect()) for d in (fit, stored))
    assert a == b
    assert V.theme("pca")["legend"] == "none" and V.theme("common") == V.theme()


def test_genes_clusters_table(fit):
    out = S.establish_genes_clusters(fit, {"a": ["B"], "b": ["C"]}, k=4, cuts=2)
    table = out["genes"].toPandas()
    assert len(table.columns) == 17 and abs(sum(r.share for r in out["scree"].collect()) - 1) < 1e-9
    assert set(table.highlight) <= {"Genes related to a", "Genes related to b", "not_marked"} and (table.sec_markers == 1).any()


def test_imports_of_coex(spark, fit, tiny, tmp_path):
    ds = P.calculate_coex(fit.initialize_metadata("G", "m", "c"))
    made = T.to_single_cell(ds)
    genes, cells = made["genes"].drop("pos", "lambda", "dispersion"), made["cells"].drop("pos", "nu")
    again = T.from_single_cell({}, genes, cells, alternatives={"raw": {"counts": made["counts"]}}, genes_coex=made["genes_coex"])
    assert again.counts.exceptAll(tiny.counts).count() == 0 and P.coex_available(again)
    assert again.gene_coex.exceptAll(ds.gene_coex).count() == 0
    with pytest.raises(ValueError):
        T.from_single_cell({"counts": made["counts"]}, genes.where("row <> 'A'"), cells)
    with pytest.raises(ValueError):
        T.from_single_cell({}, genes, cells)
    old = T.to_legacy(ds)
    back = T.from_legacy(old["raw"], [], old["a"], old["nu"], old["lambda"], meta=old["meta"], coex=old["coex"])
    assert P.coex_available(back) and {(r.x1, r.x2): r.coex for r in back.gene_coex.collect()} == {(r.x1, r.x2): r.coex for r in ds.gene_coex.collect()}
    both = T.union_conditions({"one": tiny, "two": tiny})
    assert both.columns == ["gene", "cell", "n", "cond"] and both.count() == 2 * tiny.counts.count()


def test_counts_kept_from_a_stream(spark, tmp_path):
    from tessera.streaming import upkeep

    schema, folder = "kind string, who long", str(tmp_path / "in")
    rows = [("a", i % 3) for i in range(20)] + [("b", 1)] * 5
    for at in range(0, 25, 10):
        spark.createDataFrame(rows[at : at + 10], schema).coalesce(1).write.mode("append").parquet(folder)
        upkeep.keep(upkeep.read_events(spark, folder, schema), "kind", "who", str(tmp_path / "kept"), str(tmp_path / "marks"))
    want = {("a", 0): 7, ("a", 1): 7, ("a", 2): 6, ("b", 1): 5}
    assert {(r.gene, r.cell): r.n for r in upkeep.current(spark, str(tmp_path / "kept")).collect()} == want
    assert len([p for p in (tmp_path / "kept").iterdir() if p.name.startswith("batch=")]) == 3
    upkeep.compact(spark, str(tmp_path / "kept"), str(tmp_path / "one"))
    assert {(r.gene, r.cell): r.n for r in upkeep.current(spark, str(tmp_path / "one")).collect()} == want


def test_counts_of_closed_windows(spark, tmp_path):
    from datetime import datetime

    from tessera.streaming import upkeep

    schema, folder = "at timestamp, kind string, who long", str(tmp_path / "in")
    for day, n in ((1, 3), (2, 2), (9, 1)):
        spark.createDataFrame([(datetime(2024, 1, day, 12), "a", 1)] * n, schema).coalesce(1).write.mode("append").parquet(folder)
    events = upkeep.read_events(spark, folder, schema, files_per_trigger=10)
    got = upkeep.run_to_table(upkeep.windowed(events, "at", "kind", "who"), "closed", "append", str(tmp_path / "marks")).collect()
    assert sorted((r.window_start.day, r.n) for r in got) == [(1, 3), (2, 2)]


def test_uniform_communities_of_a_kind_are_merged(spark, monkeypatch):
    """Communities split larger kinds (seven at sf0.1); their unions are uniform, so two clusters stay."""
    from tessera.plans import pipelines
    from tessera.queries import more

    _, halves = more.planted(spark, "/root/testdata/sf0.01")
    monkeypatch.setattr(pipelines, "community_clusters", lambda *a, **o: halves)
    got = more.uniform_clusters(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 100 and {(r.cell % 2, r.least) for r in got} == {(0, min(r.cell for r in got if r.cell % 2 == 0)), (1, min(r.cell for r in got if r.cell % 2))}
