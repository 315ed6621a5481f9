"""Scores of genes: GDI, cross entropy, selection, reduced matrices, marker space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.dataset import SMALL, CountDataset, checkpoint, maybe_broadcast
from tessera.functions.special import chi_square_tail, log_neg_log, probability_of_zero
from tessera.operators.dense import Strip, tail
from tessera.operators.pairs import coex, get_coex, in_strips, p_values, statistic, statistic_of, symmetric
from tessera.operators.raw import data_matrix, expressing_cells, nu_normalised


def gdi_given_s(s: DataFrame, n_rows: int, fraction: float = 0.05) -> DataFrame:
    """``x2, gdi``: ln(-ln) of the mean p-value of the largest values of each column.

    ``s(x1, x2, s)`` holds ``n_rows`` rows a column, the zero diagonal included.
    """
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    k = max(1, int(round(n_rows * fraction)))
    rank = F.row_number().over(W.partitionBy("x2").orderBy(F.desc("s")))
    top = s.select("x2", "s").withColumn("rank", rank).where(F.col("rank") <= k)
    return top.groupBy("x2").agg(F.avg(chi_square_tail(F.col("s"))).alias("p")).select("x2", log_neg_log(F.col("p")).alias("gdi"))


def gdi_given_correlation(corr: DataFrame, degrees: float, n_rows: int, fraction: float = 0.05) -> DataFrame:
    return gdi_given_s(corr.select("x1", "x2", (F.col("corr") * F.col("corr") * degrees).alias("s")), n_rows, fraction)


def _gdi_by_strips(ds: CountDataset, kind: str, fraction: float) -> DataFrame | None:
    """``gene, gdi`` as by ``gdi_given_s``, each gene's largest values picked where they are made."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    k, own = max(1, int(round(ds.n_genes * fraction))), statistic_of(ds, kind)

    def score(strip: Strip):
        top = np.concatenate([own(strip, cols) for cols in strip.slices()], axis=1)
        if k < top.shape[1]:
            top.partition(top.shape[1] - k, axis=1)
            top = top[:, -k:]
        yield strip.names.slice(strip.first, strip.last - strip.first), tail(top).mean(1)

    made = in_strips(ds, score, "gene name, p double") if own else None
    return made and made.select("gene", log_neg_log(F.col("p")).alias("gdi"))


def gdi(ds: CountDataset, kind: str = "S", fraction: float = 0.05) -> DataFrame:
    """``gene, sum_raw_norm, gdi, exp_cells``: log10 of the normalised total, GDI, percent of cells."""
    scores = _gdi_by_strips(ds, kind, fraction)
    if scores is None:
        scores = gdi_given_s(statistic(ds, kind), ds.n_genes, fraction).withColumnRenamed("x2", "gene")
    total = nu_normalised(ds).groupBy("gene").agg(F.log10(F.sum("value")).alias("sum_raw_norm"))
    share = expressing_cells(ds).select("gene", (F.lit(100.0) * F.col("n_cells") / ds.n_cells).alias("exp_cells"))
    return scores.join(total, "gene", "left").join(share, "gene").select("gene", "sum_raw_norm", "gdi", "exp_cells")


def store_gdi(ds: CountDataset, scores: DataFrame) -> CountDataset:
    if scores.count() != ds.n_genes:
        raise ValueError("GDI needs one value a gene")
    return ds.with_gene_columns(scores.select("gene", "gdi"))


def cross_entropy(ds: CountDataset) -> DataFrame:
    """``gene, ce``: mean surprise at what was seen; 0 for genes in every cell.

    Cells of one efficiency are alike, so the cells with and without a gene are counted for each efficiency.
    """
    values = ds.cells.groupBy("nu").agg(F.count(F.lit(1)).alias("m"))
    seen = ds.counts.join(maybe_broadcast(ds.cells.select("cell", "nu"), ds.n_cells), "cell").groupBy("gene", "nu").agg(F.count(F.lit(1)).alias("k"))
    grid = ds.genes.select("gene", "lambda", "dispersion").crossJoin(maybe_broadcast(values, ds.n_cells)).join(seen, ["gene", "nu"], "left").na.fill(0, ["k"])
    p, k, none = probability_of_zero(F.col("dispersion"), F.col("lambda") * F.col("nu")), F.col("k"), F.col("m") - F.col("k")
    each = F.when(k > 0, k * F.log1p(-p)).otherwise(0.0) + F.when(none > 0, none * F.log(p)).otherwise(0.0)
    return grid.groupBy("gene").agg(F.when(F.sum(none) == 0, 0.0).otherwise(-F.sum(each) / ds.n_cells).alias("ce"))


def selected_genes(ds: CountDataset, method: str | list = "HGDI", k: int = 2000, scores: DataFrame | None = None) -> DataFrame:
    """``gene, pos`` of the genes chosen, in the order of the dataset."""
    if isinstance(method, (list, tuple)):
        chosen = ds.genes.where(F.col("gene").isin(list(method))).select("gene", "pos")
        if chosen.count() != len(set(method)):
            raise ValueError("unknown gene")
        return chosen.orderBy("pos")
    if method in ("", "HGDI"):
        if scores is None:
            scores = ds.genes.select("gene", "gdi") if "gdi" in ds.genes.columns else gdi(ds).select("gene", "gdi")
        ranked = scores.join(ds.genes.select("gene", "pos"), "gene").orderBy(F.desc("gdi"), "pos")
    elif method in ("HVG_Scanpy", "mean.var.plot"):
        ranked = dispersion_by_bins(ds).orderBy(F.desc("score"), "pos")
    elif method in ("HVG_Seurat", "vst"):
        ranked = variance_after_trend(ds).orderBy(F.desc("score"), "pos")
    else:
        raise ValueError(f"unknown method {method}")
    return ranked.limit(k).select("gene", "pos").orderBy("pos")


def _moments(ds: CountDataset, values: DataFrame) -> DataFrame:
    sums = values.groupBy("gene").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    mean = F.col("s1") / ds.n_cells
    return ds.genes.select("gene", "pos").join(sums, "gene").select("gene", "pos", mean.alias("mean"), ((F.col("s2") - ds.n_cells * mean * mean) / max(ds.n_cells - 1, 1)).alias("var"))


def dispersion_by_bins(ds: CountDataset, bins: int = 20) -> DataFrame:
    """``gene, pos, score``: log dispersion, standardised among genes of like mean."""
    rows = _moments(ds, data_matrix(ds)).where("mean > 0 and var > 0").select("gene", "pos", F.log1p("mean").alias("mean"), F.log(F.col("var") / F.col("mean")).alias("d"))
    span = rows.agg(F.min("mean"), F.max("mean")).first()
    width = ((span[1] or 0) - (span[0] or 0)) / bins or 1.0
    placed = rows.withColumn("bin", F.least(F.floor((F.col("mean") - F.lit(span[0] or 0.0)) / width), F.lit(bins - 1)))
    w = W.partitionBy("bin")
    spread = F.coalesce(F.nullif(F.stddev("d").over(w), F.lit(0.0)), F.lit(1.0))
    return placed.select("gene", "pos", ((F.col("d") - F.avg("d").over(w)) / spread).alias("score"))


def variance_after_trend(ds: CountDataset, span: float = 0.3) -> DataFrame:
    """``gene, pos, score``: variance of counts standardised by a local quadratic trend, clipped at sqrt(C)."""
    from tessera.algos.smooth import loess

    if ds.n_genes > SMALL:
        raise ValueError(f"more than {SMALL} genes: their trend is fitted on the driver")
    rows = _moments(ds, data_matrix(ds, "raw")).where("mean > 0 and var > 0").orderBy("pos").toPandas()
    x, y = np.log10(rows["mean"].to_numpy()), np.log10(rows["var"].to_numpy())
    rows["sd"] = np.sqrt(10 ** loess(x, y, span))
    table = ds.spark.createDataFrame(rows[["gene", "pos", "mean", "sd"]])
    limit = float(np.sqrt(ds.n_cells))
    z = F.least((F.col("n") - F.col("mean")) / F.col("sd"), F.lit(limit))
    seen = ds.counts.join(table, "gene").groupBy("gene").agg(F.sum(z * z).alias("s"), F.count(F.lit(1)).alias("k"))
    zero = (ds.n_cells - F.col("k")) * (F.col("mean") / F.col("sd")) ** 2
    return table.join(seen, "gene").select("gene", "pos", ((F.col("s") + zero) / max(ds.n_cells - 1, 1)).alias("score"))


#: Genes whose matrix by genes the driver holds (3 GB with its work space).
MOST_GENES = 10_000


def matrix_of(rows: DataFrame, row: str, column: str, value: str, row_names: list, column_names: list) -> np.ndarray:
    """A dense matrix on the driver, for algorithms that need one; sizes are the caller's choice."""
    pdf = rows.select(row, column, value).toPandas()
    out = np.zeros((len(row_names), len(column_names)))
    at_row, at_col = pd.Index(row_names), pd.Index(column_names)
    i, j = at_row.get_indexer(pdf[row]), at_col.get_indexer(pdf[column])
    ok = (i >= 0) & (j >= 0)
    out[i[ok], j[ok]] = pdf[value].to_numpy(float)[ok]
    return out


#: Rows of the Gram matrix that a pass over the cells sums, and cells whose values a task spreads at once.
GRAM_ROWS, GRAM_CELLS = 1024, 512


def coex_matrix(ds: CountDataset) -> np.ndarray:
    """COEX of all genes on the driver, in the order of ``pos``: eight bytes a pair and no names."""
    n = ds.n_genes
    if ds.gene_coex is None:

        def rows(strip: Strip):
            whole = np.concatenate([strip.coex(cols) for cols in strip.slices()], axis=1)
            yield pa.array(np.arange(strip.first, strip.last)), pa.array([r.tobytes() for r in whole], pa.binary())

        out = np.zeros((n, n))
        for batch in in_strips(ds, rows, "i long, data binary").toArrow().to_batches():
            for i, data in zip(batch.column("i").to_numpy(), batch.column("data"), strict=True):
                out[i] = np.frombuffer(data.as_buffer())
        return out
    at = ds.genes.orderBy("pos").select("gene").toArrow().column("gene").combine_chunks()
    at = maybe_broadcast(ds.spark.createDataFrame(pa.table({"gene": at, "i": pa.array(np.arange(n, dtype=np.int32))})), n)
    pairs = ds.gene_coex.join(at.toDF("x1", "i"), "x1").join(at.toDF("x2", "j"), "x2").select("i", "j", "coex").toArrow()
    i, j, v = (pairs.column(c).to_numpy() for c in ("i", "j", "coex"))
    out = np.zeros((n, n))
    out[i, j] = out[j, i] = v
    return out


def _spread(own: pa.Array, n: int) -> np.ndarray:
    """Lists of (position, value) as rows of a dense matrix."""
    out, sizes = np.zeros((len(own), n)), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = own.flatten()
    i, v = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    np.add.at(out, (np.repeat(np.arange(len(sizes)), sizes), i), v)
    return out


def _gram(lists: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of products, sums) of the positions: each task sums its cells, and only sums leave it."""
    gram, sums = np.zeros((n, n)), np.zeros(n)
    for low in range(0, n, GRAM_ROWS):
        high = min(n, low + GRAM_ROWS)

        def products(batches: Iterator[pa.RecordBatch], low: int = low, high: int = high) -> Iterator[pa.RecordBatch]:
            total = np.zeros((high - low + 1, n))
            for batch in batches:
                for k in range(0, batch.num_rows, GRAM_CELLS):
                    x = _spread(batch.column("own").slice(k, GRAM_CELLS), n)
                    total[:-1] += x[:, low:high].T @ x
                    total[-1] += x.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[low:high, -1]), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "data"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            i, total = None, 0.0
            for batch in batches:
                for k in range(batch.num_rows):
                    i, total = batch.column("i")[k].as_py(), total + np.frombuffer(batch.column("data")[k].as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["i", "data"])

        kinds = "i long, data binary"
        for batch in lists.mapInArrow(products, kinds).groupBy("i").applyInArrow(add, kinds).toArrow().to_batches():
            for i, data in zip(batch.column("i").to_numpy(), batch.column("data"), strict=True):
                (sums if i < 0 else gram[i])[:] = np.frombuffer(data.as_buffer())
    return gram, sums


def reduced_matrix(ds: CountDataset, use_coex: bool = False, method: str = "", components: int = 25, genes: str | list = "", k: int = 2000, scaled: bool = True) -> DataFrame:
    """``cell, values``: cells in few dimensions, by eigenvectors of COEX or by principal components.

    Each cell's values are put in a list once; tasks sum the Gram matrix of the genes over their cells
    and project them. Only a matrix of genes by genes is on the driver, of ``MOST_GENES`` at most.
    Principal components are those of the correlations, or of the covariances if not ``scaled``.
    """
    wanted = ds.genes if use_coex or genes == "all" else selected_genes(ds, genes, k)
    found = wanted.orderBy("pos").select("gene").limit(MOST_GENES + 1).toArrow().column("gene").combine_chunks()
    if (n := len(found)) > MOST_GENES:
        raise ValueError(f"{wanted.count()} genes: select {MOST_GENES} of them at most")
    at = ds.spark.createDataFrame(pa.table({"gene": found, "i": pa.array(np.arange(n, dtype=np.int32))}))
    own = F.collect_list(F.struct("i", F.col("value").cast("double").alias("value"))).alias("own")
    lists = checkpoint(data_matrix(ds, method).join(F.broadcast(at), "gene").groupBy("cell").agg(own))
    if use_coex:
        lam, vec = np.linalg.eigh(coex_matrix(ds))
        basis, shift, scale = vec[:, np.argsort(-np.abs(lam))[:components]].copy(), np.zeros(n), np.ones(n)
    else:
        cov, sums = _gram(lists, n)
        shift = sums / ds.n_cells
        cov -= ds.n_cells * np.outer(shift, shift)
        cov /= max(ds.n_cells - 1, 1)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-30)) if scaled else np.ones(n)
        cov /= np.outer(scale, scale)
        lam, vec = np.linalg.eigh(cov)
        basis = vec[:, np.argsort(-lam)[:components]].copy()
    weights = basis / scale[:, None]
    base, d = (shift[:, None] * weights).sum(0), weights.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GRAM_CELLS):
                some = batch.slice(at, GRAM_CELLS)
                v = _spread(some.column("own"), n) @ weights - base
                if use_coex:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        v /= np.sqrt((v * v).sum(1, keepdims=True) / max(d - 1, 1))
                yield pa.RecordBatch.from_arrays([some.column("cell"), pa.ListArray.from_arrays(np.arange(0, v.size + 1, max(d, 1), dtype=np.int32), pa.array(v.ravel()))], ["cell", "values"])

    kind = ds.cells.schema["cell"].dataType.simpleString()
    return ds.cells.select("cell").join(lists, "cell", "left").mapInArrow(project, f"cell {kind}, values array<double>")


def markers_near(ds: CountDataset, markers: list, k: int = 25) -> DataFrame:
    """``gene, pos, marker, rank``: for each marker its k genes of lowest p-value, and the marker itself."""
    p = p_values(ds, subset=markers).join(ds.genes.select(F.col("gene").alias("x1"), "pos"), "x1")
    rank = F.row_number().over(W.partitionBy("x2").orderBy("p_value", "pos"))
    return p.withColumn("rank", rank).where((F.col("rank") <= k) | (F.col("x1") == F.col("x2"))).select(F.col("x1").alias("gene"), "pos", F.col("x2").alias("marker"), "rank")


def genes_coex_space(ds: CountDataset, markers: list, k: int = 25) -> DataFrame:
    """``x1, x2, gcs``: tanh(coex sqrt(C)) of genes of high local index against secondary markers."""
    known = [r["gene"] for r in ds.genes.where(F.col("gene").isin(list(markers))).select("gene").collect()]
    secondary = [r["gene"] for r in markers_near(ds, known, k).select("gene").distinct().collect()]
    pairs = checkpoint(get_coex(ds, secondary))
    s = pairs.select(F.col("x2").alias("x1"), F.col("x1").alias("x2"), (F.col("coex") * F.col("coex") * ds.n_cells).alias("s"))
    local = gdi_given_s(s, len(secondary), 0.1)
    limit = local.agg(F.percentile("gdi", 0.9)).first()[0]
    keep = local.where(F.col("gdi") >= limit).select(F.col("x2").alias("x1"))
    return pairs.join(keep, "x1", "left_semi").select("x1", "x2", F.tanh(F.col("coex") * float(np.sqrt(ds.n_cells))).alias("gcs"))


def genes_clusters(ds: CountDataset, groups: dict[str, list], k: int = 25, cuts: int = 6, method: str = "ward.D2") -> DataFrame:
    """``gene, cluster, group, pc``: genes of the marker space by clustering, with the group nearest to each."""
    from tessera.algos.hierarchy import Distances, cut_tree, linkage

    markers = sorted({g for v in groups.values() for g in v})
    space = checkpoint(genes_coex_space(ds, markers, k))
    pdf = space.toPandas().pivot(index="x1", columns="x2", values="gcs").fillna(0.0).sort_index()
    x = pdf.to_numpy()
    u, sv, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    pc = (u * sv)[:, :10]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    merges = linkage(Distances.cosine(unit), method)
    labels = cut_tree(merges, len(x), min(cuts, len(x)))
    known = [r["gene"] for r in ds.genes.where(F.col("gene").isin(markers)).select("gene").collect()]
    ranks = markers_near(ds, known, ds.n_genes).join(maybe_broadcast(space.select(F.col("x1").alias("gene")).distinct(), ds.n_genes), "gene", "left_semi")
    of = {(r["gene"], r["marker"]): r["rank"] for r in ranks.select("gene", "marker", "rank").collect()}
    rows = []
    for i, g in enumerate(pdf.index):
        total = {}
        for name, own in groups.items():
            have = [m for m in own if m in pdf.columns]
            if g in own:
                total[name] = 1
            elif any(pdf.loc[g, m] < 0 for m in have):
                total[name] = 100000
            else:
                total[name] = sum(of.get((g, m), 100000) for m in have) or 100000
        best = min(total.values())
        nearest = [n for n, v in total.items() if v == best]
        rows.append((g, int(labels[i]), nearest[0] if len(nearest) == 1 and best < 100000 else "none", [float(v) for v in pc[i]]))
    return ds.spark.createDataFrame(rows, ["gene", "cluster", "group", "pc"])


#: Fixed value: the colour of what belongs to no group.
NO_COLOUR = "#BBBBBB"


def establish_genes_clusters(ds: CountDataset, groups: dict[str, list], k: int = 25, cuts: int = 6, method: str = "ward.D2") -> dict[str, DataFrame]:
    """``gcs`` (x1, x2, gcs), ``scree`` (component, share) and ``genes``: the whole table of the marker space.

    ``genes`` has pc1 to pc10, highlight (the group that a gene is nearest to), hclust, sec_markers,
    colors, col_branches and group_labels: a branch takes the colour and the name of a group whose
    marker it holds.
    """
    from tessera.operators.plotdata import colours, scree

    space = checkpoint(genes_coex_space(ds, sorted({g for v in groups.values() for g in v}), k))
    rows = genes_clusters(ds, groups, k, cuts, method).toPandas()
    secondary = {r["x2"] for r in space.select("x2").distinct().collect()}
    paint = dict(zip(groups, colours(len(groups)), strict=True))
    pc = np.array(rows.pop("pc").tolist())
    pc = np.c_[pc, np.zeros((len(pc), max(0, 10 - pc.shape[1])))]
    holds = {c: [g for g, own in groups.items() if set(own) & set(part["gene"])] for c, part in rows.groupby("cluster")}
    out = []
    for i, r in enumerate(rows.itertuples()):
        branch = holds[r.cluster][-1] if holds[r.cluster] else None
        note = "not_marked" if r.group == "none" else f"Genes related to {r.group}"
        colour = paint.get(r.group, NO_COLOUR)
        out.append((r.gene, *map(float, pc[i]), note, int(r.cluster), float(r.gene in secondary), colour, paint.get(branch, NO_COLOUR), branch or str(r.cluster)))
    names = ["gene", *(f"pc{i}" for i in range(1, 11)), "highlight", "hclust", "sec_markers", "colors", "col_branches", "group_labels"]
    sd = ds.spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(pc.std(0, ddof=1) if len(pc) > 1 else np.zeros(10))], "component int, sd double")
    return {"gcs": space, "scree": scree(sd), "genes": ds.spark.createDataFrame(out, names)}
