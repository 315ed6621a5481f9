"""The tables behind the diagnostic plots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.dataset import CountDataset, checkpoint, maybe_broadcast
from tessera.operators.clusters import cluster_summary, dea, dea_p_values
from tessera.operators.labels import CONDITION, get_labels
from tessera.operators.pairs import coex, p_values
from tessera.operators.raw import cell_sizes, expressed_genes, fully_expressed, nu_normalised
from tessera.operators.scores import gdi


def _samples(ds: CountDataset, conditions: DataFrame | None) -> DataFrame:
    rows = conditions if conditions is not None else get_labels(ds, "", CONDITION)
    return maybe_broadcast(rows.toDF("cell", "sample"), ds.n_cells)


def size_curve(ds: CountDataset, conditions: DataFrame | None = None) -> DataFrame:
    """``cell, sample, size, rank``: library sizes from the largest down, by sample."""
    rows = cell_sizes(ds).join(_samples(ds, conditions), "cell")
    return rows.select("cell", "sample", "size", F.row_number().over(W.partitionBy("sample").orderBy(F.desc("size"), "pos")).alias("rank"))


def _with_quartiles(rows: DataFrame, value: str) -> DataFrame:
    w = W.partitionBy("sample")
    ranks = F.row_number().over(w.orderBy(value, "pos"))
    quartiles = rows.groupBy("sample").agg(*[F.percentile(value, q).alias(n) for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])
    return rows.select("cell", "sample", value, ranks.alias("rank")).join(quartiles, "sample")


def cell_size_plot(ds: CountDataset, conditions: DataFrame | None = None) -> DataFrame:
    """``cell, sample, size, rank, q1, q2, q3``."""
    return _with_quartiles(cell_sizes(ds).join(_samples(ds, conditions), "cell"), "size")


def genes_size_plot(ds: CountDataset, conditions: DataFrame | None = None) -> DataFrame:
    """``cell, sample, n_genes, rank, q1, q2, q3``."""
    return _with_quartiles(expressed_genes(ds).join(_samples(ds, conditions), "cell"), "n_genes")


def genes_percentage(ds: CountDataset, genes: list | None = None, pattern: str = "", conditions: DataFrame | None = None) -> DataFrame:
    """``cell, sample, size, sum, percentage`` of some genes, named or matched by a pattern."""
    wanted = F.col("gene").isin(list(genes)) if genes else F.col("gene").cast("string").rlike(pattern)
    if not ds.genes.where(wanted).limit(1).count():
        raise ValueError("none of these genes is there")
    part = ds.counts.groupBy("cell").agg(F.coalesce(F.sum(F.when(wanted, F.col("n"))), F.lit(0)).alias("sum"))
    rows = cell_sizes(ds).join(part, "cell", "left").na.fill(0, ["sum"]).join(_samples(ds, conditions), "cell")
    share = F.when(F.col("size") > 0, 100.0 * F.col("sum") / F.col("size"))
    return rows.select("cell", "sample", "size", "sum", share.alias("percentage"))


def mitochondrial_percentage(ds: CountDataset, prefix: str = "^MT-", conditions: DataFrame | None = None) -> DataFrame:
    return genes_percentage(ds, None, prefix, conditions).withColumnsRenamed({"sum": "sum_mit", "percentage": "mit_percentage"})


def scatter(ds: CountDataset, conditions: DataFrame | None = None) -> DataFrame:
    """``cell, sample, size, n_genes``."""
    return cell_sizes(ds).join(expressed_genes(ds).select("cell", "n_genes"), "cell").join(_samples(ds, conditions), "cell").select("cell", "sample", "size", "n_genes")


def sorted_nu(ds: CountDataset, first: int = 100, bend: float = -0.01, below: float = 0.005) -> DataFrame:
    """``rank, nu, second, threshold``: efficiencies in order, and the elbow among the first of them."""
    low = ds.cells.select("cell", "pos", "nu").orderBy("nu", "pos").limit(first)
    w = W.orderBy("nu", "pos")
    rows = low.select(F.row_number().over(w).alias("rank"), "nu", (F.lead("nu", 2).over(w) - 2 * F.lead("nu", 1).over(w) + F.col("nu")).alias("second"))
    at = rows.where(F.col("second") < bend).agg(F.max("rank").alias("at"))
    threshold = rows.join(F.broadcast(at), F.col("rank") == F.col("at") + 1).select((F.col("nu") - below).alias("threshold"))
    limit = F.broadcast(threshold.agg(F.max("threshold").alias("threshold"), F.lit(1).alias("k")))
    return rows.withColumn("k", F.lit(1)).join(limit, "k").drop("k")


def scree(deviations: DataFrame) -> DataFrame:
    """``component, share`` of the variance from ``component, sd``."""
    v = F.col("sd") * F.col("sd")
    return deviations.select("component", (v / F.sum(v).over(W.partitionBy())).alias("share"))


def clean_plots(ds: CountDataset, include_pca: bool = True) -> dict[str, DataFrame]:
    """``nu`` (see ``sorted_nu``) and, with principal components, ``cells`` and ``genes``.

    ``cells`` has pc1 to pc5, log_nu and groups: of the two branches of the cells' tree (complete
    linkage over standardised components) A is the larger. ``genes`` ranks the genes by their mean
    in B. With more cells than the tree takes B holds the first cell alone, with a warning.
    """
    out = {"nu": sorted_nu(ds)}
    if not include_pca:
        return out
    import warnings

    import numpy as np

    from tessera.algos.hierarchy import MOST, cut_tree, linkage
    from tessera.operators.scores import reduced_matrix

    reduced = checkpoint(reduced_matrix(ds, method="NuNorm", components=5, genes="all", scaled=False))
    if ds.n_cells > MOST:
        warnings.warn(f"more than {MOST} cells: group B is the first of them", stacklevel=2)
        groups = ds.cells.select("cell", F.when(F.col("pos") == F.lit(ds.cells.agg(F.min("pos")).first()[0]), "B").otherwise("A").alias("groups"))
    else:
        rows = reduced.join(ds.cells.select("cell", "pos"), "cell").orderBy("pos").toPandas()
        x = np.array(rows["values"].tolist())
        x = (x - x.mean(0)) / np.maximum(x.std(0, ddof=1) if len(x) > 1 else 1.0, 1e-12)
        square = (x * x).sum(1)
        labels = cut_tree(linkage(np.sqrt(np.maximum(square[:, None] + square - 2 * x @ x.T, 0)), "complete"), len(x), min(2, len(x)))
        large = 1 if (labels == 1).sum() >= (labels == 2).sum() else 2
        kind = ds.cells.schema["cell"].dataType.simpleString()
        cells = rows["cell"].tolist()
        groups = ds.spark.createDataFrame([(c, "A" if v == large else "B") for c, v in zip(cells, labels.tolist(), strict=True)], f"cell {kind}, groups string")
    groups = checkpoint(groups)
    pcs = [F.coalesce(F.get("values", F.lit(i)), F.lit(0.0)).alias(f"pc{i + 1}") for i in range(5)]
    log_nu = F.log(F.round("nu", 7)).alias("log_nu")
    out["cells"] = reduced.join(groups, "cell").join(ds.cells.select("cell", "nu"), "cell").select("cell", *pcs, "groups", log_nu)
    members = groups.where("groups = 'B'").select("cell")
    n = members.count()
    sums = nu_normalised(ds).join(maybe_broadcast(members, n), "cell").groupBy("gene").agg((F.sum(F.round("value", 4)) / max(n, 1)).alias("mean"))
    ranked = sums.join(ds.genes.select("gene", "pos"), "gene").where(F.col("mean") > 2.220446049250313e-16)
    out["genes"] = ranked.select("gene", "mean", F.row_number().over(W.orderBy(F.desc("mean"), "pos")).alias("rank"))
    return out


def cells_umap(
    ds: CountDataset, name: str = "", clusters: DataFrame | dict | None = None, use_coex: bool = False, method: str = "LogNormalized",
    components: int = 25, genes: str | list = "HGDI", k: int = 200, neighbours: int = 30, min_dist: float = 0.3, epochs: int = 200,
) -> tuple[DataFrame, DataFrame, str]:
    """(``cell, x, y, cluster``, reduced matrix, title): cells in two dimensions with their clusters.

    The layout is on the driver, for ``MOST`` cells at most. Without any clusterization all cells are
    one cluster.
    """
    import numpy as np

    from tessera.algos.communities import embed
    from tessera.algos.hierarchy import MOST
    from tessera.operators.labels import label_names, name_and_labels
    from tessera.operators.scores import reduced_matrix

    if ds.n_cells > MOST:
        raise ValueError(f"more than {MOST} cells: lay out a part of them")
    if clusters is None and not name and not label_names(ds):
        name, clusters = "AllCells", ds.cells.select("cell", F.lit("1").alias("cluster"))
    name, clusters = name_and_labels(ds, name, clusters)
    reduced = checkpoint(reduced_matrix(ds, use_coex=use_coex, method=method, components=components, genes=genes, k=k))
    rows = reduced.join(ds.cells.select("cell", "pos"), "cell").orderBy("pos").toPandas()
    y = embed(np.array(rows["values"].tolist()), neighbours, min_dist, epochs)
    kind = ds.cells.schema["cell"].dataType.simpleString()
    points = ds.spark.createDataFrame([(c, float(a), float(b)) for c, (a, b) in zip(rows["cell"].tolist(), y, strict=True)], f"cell {kind}, x double, y double")
    how = "COEX eigenvectors projection" if use_coex else f"{genes} genes selector" if isinstance(genes, str) else "user provided genes"
    return points.join(clusters, "cell"), reduced, f"UMAP of clusterization {name} using {method} matrix with {how}"


def gdi_plot(ds: CountDataset, groups: DataFrame | None = None, kind: str = "S", scores: DataFrame | None = None) -> DataFrame:
    """``gene, sum_raw_norm, gdi, group, q50, q75`` of genes with a GDI above -5: of those given, stored or made now."""
    if scores is None and "gdi" in ds.genes.columns:
        sums = nu_normalised(ds).groupBy("gene").agg(F.log10(F.sum("value")).alias("sum_raw_norm"))
        scores = ds.genes.select("gene", "gdi").join(sums, "gene", "left")
    rows = (scores if scores is not None else gdi(ds, kind)).where(F.col("gdi") > -5)
    q = rows.agg(F.percentile("gdi", 0.5).alias("q50"), F.percentile("gdi", 0.75).alias("q75"), F.lit(1).alias("k"))
    named = rows.join(maybe_broadcast(groups.select("gene", "group"), ds.n_genes), "gene", "left") if groups is not None else rows.withColumn("group", F.lit(None).cast("string"))
    out = named.withColumn("k", F.lit(1)).join(F.broadcast(q), "k")
    return out.select("gene", "sum_raw_norm", "gdi", F.coalesce("group", F.lit("none")).alias("group"), "q50", "q75")


def heatmap(ds: CountDataset, columns: list, rows: DataFrame, limit: float = 0.01, condition: str = "", flags: bool = False) -> DataFrame:
    """``x2, x1, coex, p_value, condition, type, absent``: requested pairs; unlikely coex is kept, other set to 0.

    ``rows(gene, type)`` may name genes that the dataset lacks: they come with p = 1 and ``absent``.
    With ``flags`` a column ``fe_genes`` says whether one of the two is fully expressed.
    """
    both = coex(ds, subset=columns).join(p_values(ds, subset=columns), ["x1", "x2"])
    wanted = rows.crossJoin(maybe_broadcast(ds.genes.where(F.col("gene").isin(list(columns))).select(F.col("gene").alias("x2")), len(columns)))
    out = wanted.withColumnRenamed("gene", "x1").join(both, ["x1", "x2"], "left")
    absent = F.col("p_value").isNull()
    value = F.when(absent | (F.col("p_value") > limit) | (F.col("x1") == F.col("x2")), 0.0).otherwise(F.col("coex"))
    made = out.select("x2", "x1", value.alias("coex"), F.coalesce("p_value", F.lit(1.0)).alias("p_value"), F.lit(condition).alias("condition"), "type", absent.alias("absent"))
    if not flags:
        return made
    full = maybe_broadcast(fully_expressed(ds), ds.n_genes)
    one, two = (full.select(F.col("gene").alias(x), F.lit(True).alias(f"_{x}")) for x in ("x1", "x2"))
    flagged = made.join(one, "x1", "left").join(two, "x2", "left")
    return flagged.select(*made.columns, F.coalesce("_x1", "_x2", F.lit(False)).alias("fe_genes"))


def heatmap_of_conditions(spark: SparkSession, folder: str, conditions: list[str], columns: list, rows: DataFrame, limit: float = 0.01) -> DataFrame:
    """``heatmap`` with its flags over datasets saved under their conditions; what cannot be read is left out."""
    from tessera.sources.tables import load_conditions

    found = [heatmap(ds, columns, rows, limit, name, flags=True) for name, ds in load_conditions(spark, folder, conditions).items()]
    if not found:
        raise ValueError("none of the conditions can be read")
    return reduce(DataFrame.unionByName, found)


def genes_heatmap(ds: CountDataset, primary: list, limit: float = 0.01) -> DataFrame:
    """``x1, x2, coex, p_value``: genes that go together with some primary marker for sure."""
    both = coex(ds, subset=primary).join(p_values(ds, subset=primary), ["x1", "x2"])
    keep = both.where((F.col("p_value") < limit) & (F.col("coex") > 0) & (F.col("x1") != F.col("x2"))).select("x1").distinct()
    return both.join(keep, "x1", "left_semi").select("x1", "x2", F.when(F.col("x1") == F.col("x2"), 0.0).otherwise(F.col("coex")).alias("coex"), "p_value")


def genes_blocks(ds: CountDataset, primary: list, secondary: list | None = None, limit: float = 0.01, symmetric: bool = True) -> tuple[DataFrame, tuple[float, float]]:
    """(``row_marker, x1, column_marker, x2, coex``, colour limits): genes that go with the markers, in blocks of a marker each.

    A marker's block has the genes with p below the limit and positive COEX with it. Rows are blocks
    of the secondary markers (all markers if ``symmetric``, the primary ones if there are none),
    columns those of the primary ones, or the same as the rows if ``symmetric``. The colour limits
    are the 0.001 and 0.999 quantiles of COEX.
    """
    secondary = list(dict.fromkeys([*primary, *(secondary or [])])) if symmetric else list(secondary or primary)
    markers = list(dict.fromkeys([*secondary, *primary]))
    both = checkpoint(coex(ds, subset=markers).join(p_values(ds, subset=markers), ["x1", "x2"]))
    near = both.where((F.col("p_value") < limit) & (F.col("coex") > 0)).select("x1", F.col("x2").alias("marker"))
    rows = near.where(F.col("marker").isin(secondary)).toDF("x1", "row_marker")
    columns = near.where(F.col("marker").isin(secondary if symmetric else list(primary))).toDF("x2", "column_marker")
    named, shown = ([r[0] for r in side.select(x).distinct().collect()] for side, x in ((columns, "x2"), (rows, "x1")))
    # each pair is made once, however many blocks show it
    values = checkpoint(coex(ds, subset=named, rows_of=shown)) if named and shown else both.limit(0).select("x1", "x2", "coex")
    out = values.join(rows, "x1").join(columns, "x2").select("row_marker", "x1", "column_marker", "x2", "coex")
    times = values.join(rows.groupBy("x1").agg(F.count(F.lit(1)).alias("k1")), "x1").join(columns.groupBy("x2").agg(F.count(F.lit(1)).alias("k2")), "x2")
    low, high = times.agg(*[F.percentile("coex", q, F.col("k1") * F.col("k2")) for q in (0.001, 0.999)]).first()
    return out, (round(low or 0.0, 3), round(high or 0.0, 3))


def cells_heatmap(ds: CountDataset, cells: list, clusters: DataFrame) -> DataFrame:
    """``x1, x2, coex, c1, c2``: COEX of some cells, with their clusters."""
    pairs = coex(ds, cells=True, subset=cells).where(F.col("x1").isin(list(cells)))
    of = maybe_broadcast(clusters.where(F.col("cell").isin(list(cells))), len(cells))
    return pairs.join(of.toDF("x1", "c1"), "x1").join(of.toDF("x2", "c2"), "x2").select("x1", "x2", "coex", "c1", "c2")


def cluster_summary_plot(ds: CountDataset, clusters: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """``cluster, condition, measure, value``."""
    rows = cluster_summary(ds, clusters, conditions)
    measures = [c for c in rows.columns if c not in ("cluster", "condition")]
    return rows.select("cluster", "condition", *[F.col(c).cast("double").alias(c) for c in measures]).unpivot(["cluster", "condition"], measures, "measure", "value")


def markers_heatmap(ds: CountDataset, groups: DataFrame, clusters: DataFrame, method: str = "bonferroni", scores: DataFrame | None = None) -> DataFrame:
    """``group, gene, cluster, dea, adj_p_value, mark``: all markers in all clusters, missing genes with nulls."""
    scores = scores if scores is not None else dea(ds, clusters)
    p = dea_p_values(scores, ds.n_cells, ds.n_genes, method)
    grid = groups.select("group", "gene").crossJoin(maybe_broadcast(clusters.select("cluster").distinct(), ds.n_cells))
    rows = grid.join(scores, ["gene", "cluster"], "left").join(p, ["gene", "cluster"], "left")
    v = F.col("p_value")
    mark = F.when(v.isNull(), "").when(v < 0.001, "***").when(v < 0.01, "**").when(v < 0.05, "*").when(v < 0.1, ".").otherwise("")
    return rows.select("group", "gene", "cluster", F.col("coex").alias("dea"), v.alias("adj_p_value"), mark.alias("mark"))


def markers_heatmap_parts(
    ds: CountDataset, groups: DataFrame, clusters: DataFrame, conditions: dict[str, DataFrame] | None = None, cuts: int = 3, method: str = "bonferroni"
) -> dict[str, DataFrame]:
    """All parts of the plot: ``cells``, ``tree``, ``sizes`` and a table of shares for each condition.

    ``cells`` is ``markers_heatmap`` with a column ``label``: the gene, with _1, _2 ... where it is
    repeated, in the order of the groups. ``tree`` has each cluster's place and branch, ``sizes`` its
    cells and their percentage, the shares one column a condition.
    """
    from tessera.operators.clusters import cluster_distances, cluster_tree, tree_cut

    scores = checkpoint(dea(ds, clusters))
    again = F.row_number().over(W.partitionBy("gene").orderBy("group")) - 1
    labelled = groups.select("group", "gene").withColumn("label", F.when(again > 0, F.concat_ws("_", "gene", again)).otherwise(F.col("gene").cast("string")))
    cells = markers_heatmap(ds, groups.select("group", "gene"), clusters, method, scores).join(labelled, ["group", "gene"])
    from tessera.algos.hierarchy import leaf_order

    names, merges = cluster_tree(cluster_distances(ds, clusters, scores=scores))
    places = ds.spark.createDataFrame([(names[c], i) for i, c in enumerate(leaf_order(merges, len(names)))], "cluster string, place int")
    tree = tree_cut(ds, clusters, cuts, scores=scores).join(places, "cluster")
    summary = cluster_summary(ds, clusters)
    sizes = summary.select("cluster", "cell_number", F.concat(F.round("cell_percentage", 1).cast("string"), F.lit("%")).alias("label"))
    return {"cells": cells, "tree": tree, "sizes": sizes} | {name: condition_shares(clusters, of) for name, of in (conditions or {}).items()}


def condition_shares(clusters: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row a cluster, one column a condition: its share of the cluster."""
    n = clusters.join(conditions, "cell").groupBy("cluster", "condition").agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("cluster")))
    return share.groupBy("cluster").pivot("condition").agg(F.first("share")).na.fill(0.0)


def centroids(points: DataFrame) -> DataFrame:
    """``type, x, y``: mean of each type's points."""
    return points.groupBy("type").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


#: Colours of series, recycled when more are asked for.
COLOURS = ("#4477AA", "#EE6677", "#228833", "#CCBB44", "#66CCEE", "#AA3377", "#BBBBBB", "#000000")


def colours(n: int = 0) -> list[str]:
    return [COLOURS[i % len(COLOURS)] for i in range(n or len(COLOURS))]


def theme(kind: str = "") -> dict:
    """Sizes and colours of a kind of plot; ``common`` ones where the kind has none of its own."""
    common = {"axis_text": 14, "axis_title": 14, "text_colour": COLOURS[0], "legend": "right", "background": "white"}
    own = {
        "pca": {"legend": "none"},
        "genes": {"title_size": 20},
        "UDE": {"legend": "right", "title_size": 20},
        "heatmap": {"axis_text": 10, "legend": "bottom"},
        "GDI": {"legend": "bottom", "title_size": 20},
        "UMAP": {"legend": "right", "title_size": 12},
        "size-plot": {"axis_text_x": None},
    }
    if kind and kind not in ("common", *own):
        raise ValueError(f"no theme {kind}")
    return common | own.get(kind, {})
