"""Differential expression of clusters: DEA, p-values, fold changes, distances, markers, enrichment.

``clusters`` is always ``cell, cluster``. Expected values use the distinct efficiencies of each
cluster, so the dense part has genes x clusters x distinct efficiencies rows, not genes x cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.dataset import CountDataset, maybe_broadcast
from tessera.functions.special import chi_square_tail, probability_of_zero
from tessera.operators.raw import nu_normalised

#: Fixed value: the steepness of the enrichment score.
THETA = -10 * math.log(0.25)


def _sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_in"))


def _observed(ds: CountDataset, clusters: DataFrame) -> DataFrame:
    """``gene, cluster, o_yi``: cells of the cluster with the gene."""
    return ds.counts.join(maybe_broadcast(clusters, ds.n_cells), "cell").groupBy("gene", "cluster").agg(F.count(F.lit(1)).alias("o_yi"))


def _expected(ds: CountDataset, clusters: DataFrame) -> DataFrame:
    """``gene, cluster, ni``: expected cells of the cluster without the gene."""
    values = ds.cells.select("cell", "nu").join(clusters, "cell").groupBy("cluster", "nu").agg(F.count(F.lit(1)).alias("m"))
    p0 = probability_of_zero(F.col("dispersion"), F.col("lambda") * F.col("nu"))
    return ds.genes.select("gene", "lambda", "dispersion").crossJoin(values).groupBy("gene", "cluster").agg(F.sum(F.col("m") * p0).alias("ni"))


def dea_tables(ds: CountDataset, clusters: DataFrame) -> DataFrame:
    """``gene, cluster, n_in, ni, no, yi, yo, o_yi``: expected and observed counts in and out of each cluster."""
    expected = _expected(ds, clusters)
    total = F.sum("ni").over(W.partitionBy("gene"))
    rows = (
        expected.withColumn("no", total - F.col("ni"))
        .join(maybe_broadcast(_sizes(clusters), ds.n_cells), "cluster")
        .join(_observed(ds, clusters), ["gene", "cluster"], "left")
        .withColumn("o_yi", F.coalesce("o_yi", F.lit(0)))
    )
    return rows.select("gene", "cluster", "n_in", "ni", "no", (F.col("n_in") - F.col("ni")).alias("yi"), (F.lit(ds.n_cells) - F.col("n_in") - F.col("no")).alias("yo"), "o_yi")


def dea(ds: CountDataset, clusters: DataFrame) -> DataFrame:
    """``gene, cluster, coex``: co-expression of each gene with membership of each cluster."""
    spread = sum((1 / F.greatest(F.lit(1.0), F.col(c)) for c in ("ni", "no", "yi", "yo")), F.lit(0.0))
    value = (F.col("o_yi") - F.col("yi")) / math.sqrt(max(ds.n_cells, 1)) * F.sqrt(spread)
    return dea_tables(ds, clusters).select("gene", "cluster", value.alias("coex"))


def cluster_gene_table(ds: CountDataset, gene, cells: DataFrame) -> DataFrame:
    """One row: expected and observed counts of a gene in and out of some cells."""
    member = ds.cells.select("cell").join(cells.select("cell").withColumn("in_", F.lit("in")), "cell", "left")
    clusters = member.select("cell", F.coalesce("in_", F.lit("out")).alias("cluster"))
    one = CountDataset(ds.counts.where(F.col("gene") == F.lit(gene)), ds.genes.where(F.col("gene") == F.lit(gene)), ds.cells, n_genes=1, n_cells=ds.n_cells)
    return dea_tables(one, clusters).where("cluster = 'in'").drop("cluster")


ADJUSTMENTS = ("none", "bonferroni", "holm", "hochberg", "hommel", "BH", "fdr", "BY")


def adjusted(p: DataFrame, method: str, n: int, by: str = "cluster") -> DataFrame:
    """``p_value`` of all genes of a cluster, adjusted for their number."""
    if method not in ADJUSTMENTS:
        raise ValueError(f"unknown adjustment {method}")
    rising = W.partitionBy(by).orderBy("p_value", "gene")
    up = rising.rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(by).orderBy(F.desc("p_value"), F.desc("gene")).rowsBetween(W.unboundedPreceding, 0)
    rows = p.withColumn("_i", F.row_number().over(rising))
    v, i, one = F.col("p_value"), F.col("_i"), F.lit(1.0)
    if method == "none":
        out: Column = v
    elif method == "bonferroni":
        out = F.least(one, v * n)
    elif method == "holm":
        out = F.least(one, F.max((n - i + 1) * v).over(up))
    elif method == "hochberg":
        out = F.least(one, F.min((n - i + 1) * v).over(down))
    elif method in ("BH", "fdr"):
        out = F.least(one, F.min(F.lit(float(n)) / i * v).over(down))
    elif method == "BY":
        q = sum(1 / k for k in range(1, n + 1))
        out = F.least(one, F.min(F.lit(float(n) * q) / i * v).over(down))
    else:
        return _hommel(p, by)
    return rows.withColumn("p_value", out).drop("_i")


def _hommel(p: DataFrame, by: str) -> DataFrame:
    """Closed testing with Simes' test. A group's p-values are as many as the genes; one task takes a group."""
    import pandas as pd

    from tessera.algos.adjust import closed_simes

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(p_value=closed_simes(pdf["p_value"].to_numpy(float)))

    return p.groupBy(by).applyInPandas(run, p.schema)


def dea_p_values(scores: DataFrame, n_cells: int, n_genes: int, method: str = "none") -> DataFrame:
    """``gene, cluster, p_value`` of DEA scores, adjusted per cluster over all genes."""
    p = scores.select("gene", "cluster", chi_square_tail(F.col("coex") * F.col("coex") * n_cells).alias("p_value"))
    return adjusted(p, method, n_genes)


def log_fold_change(ds: CountDataset, clusters: DataFrame, floor: float = 0.05) -> DataFrame:
    """``gene, cluster, lfc``: log10 of the mean inside over the mean outside, both floored."""
    sums = nu_normalised(ds).join(maybe_broadcast(clusters, ds.n_cells), "cell").groupBy("gene", "cluster").agg(F.sum("value").alias("s"))
    grid = ds.genes.select("gene", "lambda").crossJoin(maybe_broadcast(_sizes(clusters), ds.n_cells)).join(sums, ["gene", "cluster"], "left").na.fill(0.0, ["s"])
    rest = F.sum("s").over(W.partitionBy("gene")) - F.col("s")
    low = F.col("lambda") * floor
    inside, outside = F.col("s") / F.greatest("n_in", F.lit(1)), rest / F.greatest(F.lit(ds.n_cells) - F.col("n_in"), F.lit(1))
    return grid.select("gene", "cluster", (F.log10(F.greatest(inside, low)) - F.log10(F.greatest(outside, low))).alias("lfc"))


def delta_expression(ds: CountDataset, clusters: DataFrame) -> DataFrame:
    """``gene, cluster, delta``: observed less expected cells with the gene, over the cluster's efficiency."""
    nu = ds.cells.select("cell", "nu").join(clusters, "cell").groupBy("cluster").agg(F.sum("nu").alias("nu"))
    return dea_tables(ds, clusters).join(maybe_broadcast(nu, ds.n_cells), "cluster").select("gene", "cluster", ((F.col("o_yi") - F.col("yi")) / F.col("nu")).alias("delta"))


def _profile_distance(rows: DataFrame, method: str) -> DataFrame:
    """``c1, c2, distance`` of the columns of ``gene, cluster, v``, c1 < c2."""
    a, b = (rows.select("gene", F.col("cluster").alias(f"c{i}"), F.col("v").alias(f"v{i}")) for i in (1, 2))
    pairs = a.join(b, "gene").where("c1 < c2").groupBy("c1", "c2")
    if method == "cosine":
        d = 1 - F.sum(F.col("v1") * F.col("v2")) / (F.sqrt(F.sum(F.col("v1") * F.col("v1"))) * F.sqrt(F.sum(F.col("v2") * F.col("v2"))))
    elif method == "euclidean":
        d = F.sqrt(F.sum((F.col("v1") - F.col("v2")) * (F.col("v1") - F.col("v2"))))
    elif method == "manhattan":
        d = F.sum(F.abs(F.col("v1") - F.col("v2")))
    elif method in ("maximum", "chebyshev"):
        d = F.max(F.abs(F.col("v1") - F.col("v2")))
    elif method == "minkowski":
        d = F.pow(F.sum(F.pow(F.abs(F.col("v1") - F.col("v2")), 3)), 1 / 3)
    elif method == "canberra":
        both = F.abs(F.col("v1")) + F.abs(F.col("v2"))
        d = F.sum(F.when(both > 0, F.abs(F.col("v1") - F.col("v2")) / both).otherwise(0.0))
    elif method in ("bray", "braycurtis"):
        d = F.sum(F.abs(F.col("v1") - F.col("v2"))) / F.sum(F.col("v1") + F.col("v2"))
    elif method == "correlation":
        d = 1 - F.corr("v1", "v2")
    elif method == "hellinger":
        d = F.sqrt(F.sum(F.pow(F.sqrt("v1") - F.sqrt("v2"), 2)))
    elif method == "binary":
        one, two = (F.col(v) != 0 for v in ("v1", "v2"))
        d = 1 - F.count_if(one & two) / F.nullif(F.count_if(one | two), F.lit(0))
    else:
        raise ValueError(f"unknown distance {method}")
    return pairs.agg(d.alias("distance"))


def cluster_distances(ds: CountDataset, clusters: DataFrame, use_dea: bool = True, distance: str | None = None, scores: DataFrame | None = None) -> DataFrame:
    """``c1, c2, distance``: by DEA columns (cosine) or by mean occurrence (euclidean)."""
    if use_dea:
        rows = (scores if scores is not None else dea(ds, clusters)).select("gene", "cluster", F.col("coex").alias("v"))
        return _profile_distance(rows, distance or "cosine")
    grid = ds.genes.select("gene").crossJoin(maybe_broadcast(_sizes(clusters), ds.n_cells)).join(_observed(ds, clusters), ["gene", "cluster"], "left")
    mean = F.coalesce(F.col("o_yi"), F.lit(0)) / F.col("n_in")
    return _profile_distance(grid.select("gene", "cluster", F.when(mean == 0, 1e-6).otherwise(mean).alias("v")), distance or "euclidean")


def cluster_markers(ds: CountDataset, clusters: DataFrame, n: int = 10, markers: list | None = None, method: str = "bonferroni", scores: DataFrame | None = None) -> DataFrame:
    """``cluster, gene, dea, adj_p_value, is_marker, lfc``: the n lowest and the n highest genes of each cluster."""
    scores = scores if scores is not None else dea(ds, clusters)
    rows = (
        scores.join(dea_p_values(scores, ds.n_cells, ds.n_genes, method), ["gene", "cluster"])
        .join(log_fold_change(ds, clusters), ["gene", "cluster"])
        .join(ds.genes.select("gene", "pos"), "gene")
    )
    low = F.row_number().over(W.partitionBy("cluster").orderBy("coex", "pos"))
    high = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("coex"), "pos"))
    ranked = rows.withColumn("low", low).withColumn("high", high)
    both = ranked.where(F.col("low") <= n).unionByName(ranked.where(F.col("high") <= n))
    known = F.col("gene").isin(list(markers)) if markers else F.lit(False)
    return both.select("cluster", "gene", F.col("coex").alias("dea"), F.col("p_value").alias("adj_p_value"), known.cast("int").alias("is_marker"), "lfc")


def enrichment(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """``group, cluster, score, n_detected, n_total`` for marker groups ``group, gene``."""
    total = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n_total"))
    found = groups.join(scores, "gene")
    part = found.groupBy("group", "cluster").agg(F.sum(1 - F.exp(-THETA * F.greatest(F.col("coex"), F.lit(0.0)))).alias("s"), F.count("coex").alias("n_detected"))
    return part.join(total, "group").select("group", "cluster", (F.col("s") / F.col("n_total")).alias("score"), "n_detected", "n_total")


def cluster_summary(ds: CountDataset, clusters: DataFrame, conditions: DataFrame | None = None, share: float = 0.25) -> DataFrame:
    """Cross table of clusters and conditions, empty combinations included."""
    cond = conditions if conditions is not None else ds.cells.select("cell", F.lit("NoCond").alias("condition"))
    rows = clusters.join(cond, "cell").join(ds.cells.select("cell", "nu"), "cell")
    grid = clusters.select("cluster").distinct().crossJoin(cond.select("condition").distinct())
    each = rows.groupBy("cluster", "condition").agg(F.count(F.lit(1)).alias("cell_number"), F.avg("nu").alias("mean_ude"), F.median("nu").alias("median_ude"))
    seen = ds.counts.join(maybe_broadcast(rows.select("cell", "cluster", "condition"), ds.n_cells), "cell").groupBy("cluster", "condition", "gene").agg(F.count(F.lit(1)).alias("k"))
    genes = (
        seen.join(each.select("cluster", "condition", "cell_number"), ["cluster", "condition"])
        .groupBy("cluster", "condition")
        .agg(F.count_if(F.col("k") > F.col("cell_number") * share).alias("exp_genes_25"), F.count(F.lit(1)).alias("exp_genes"))
    )
    out = grid.join(each, ["cluster", "condition"], "left").join(genes, ["cluster", "condition"], "left").na.fill(0, ["cell_number", "exp_genes_25", "exp_genes"])
    percent = 100.0 * F.col("cell_number") / ds.n_cells
    return out.select("cluster", "condition", "cell_number", percent.alias("cell_percentage"), "mean_ude", "median_ude", "exp_genes_25", "exp_genes")


def cluster_tree(distances: DataFrame, method: str = "ward.D2") -> tuple[list, list]:
    """(names, merges) of a clustering of the clusters, on the driver."""
    import numpy as np

    from tessera.algos.hierarchy import linkage

    pdf = distances.toPandas()
    names = sorted(set(pdf["c1"]) | set(pdf["c2"]))
    at = {c: i for i, c in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for r in pdf.itertuples():
        d[at[r.c1], at[r.c2]] = d[at[r.c2], at[r.c1]] = r.distance
    return names, linkage(d, method)


def tree_cut(ds: CountDataset, clusters: DataFrame, cuts: int, **options) -> DataFrame:
    """``cluster, branch``: branches of the tree of clusters, at most one a cluster."""
    from tessera.algos.hierarchy import cut_tree

    names, merges = cluster_tree(cluster_distances(ds, clusters, **options))
    labels = cut_tree(merges, len(names), min(cuts, len(names)))
    return ds.spark.createDataFrame([(n, int(b)) for n, b in zip(names, labels, strict=True)], ["cluster", "branch"])


def reorder_clusters(ds: CountDataset, clusters: DataFrame, reverse: bool = False, keep_minus_one: bool = True, **options) -> tuple[DataFrame, dict]:
    """(clusters, old label -> new label): near clusters get near labels. ``-1`` may stay as it is."""
    from tessera.algos.hierarchy import leaf_order

    real = clusters.where("cluster <> '-1'") if keep_minus_one else clusters
    names = sorted(r["cluster"] for r in real.select("cluster").distinct().collect())
    if len(names) <= 1:
        return clusters, {n: n for n in names}
    distances = cluster_distances(ds, clusters, **options)
    if keep_minus_one:
        distances = distances.where("c1 <> '-1' and c2 <> '-1'")
    names, merges = cluster_tree(distances)
    order = leaf_order(merges, len(names))
    if reverse:
        order = order[::-1]
    change = {names[old]: names[new] for new, old in enumerate(order)}
    table = ds.spark.createDataFrame(list(change.items()), ["cluster", "new"])
    return clusters.join(maybe_broadcast(table, len(change)), "cluster", "left").select("cell", F.coalesce("new", "cluster").alias("cluster")), change
