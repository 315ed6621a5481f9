"""Sizes, projections, flags and filters of a count matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.algos.solvers import zero_probability
from tessera.dataset import SMALL, CountDataset, checkpoint, maybe_broadcast, settled
from tessera.functions.special import probability_of_zero


def _per(ds: CountDataset, key: str, value, name: str) -> DataFrame:
    names = ds.genes if key == "gene" else ds.cells
    made = ds.counts.groupBy(key).agg(value.alias(name))
    return names.select(key, "pos").join(made, key, "left").select(key, "pos", F.coalesce(name, F.lit(0)).cast("long").alias(name))


def cell_sizes(ds: CountDataset) -> DataFrame:
    """``cell, pos, size``: total count of each cell, empty cells included."""
    return _per(ds, "cell", F.sum("n"), "size")


def expressed_genes(ds: CountDataset) -> DataFrame:
    """``cell, pos, n_genes``: genes with a count in each cell."""
    return _per(ds, "cell", F.count(F.lit(1)), "n_genes")


def gene_sizes(ds: CountDataset) -> DataFrame:
    return _per(ds, "gene", F.sum("n"), "size")


def expressing_cells(ds: CountDataset) -> DataFrame:
    return _per(ds, "gene", F.count(F.lit(1)), "n_cells")


def zero_one(ds: CountDataset) -> DataFrame:
    return ds.counts.select("gene", "cell", F.lit(1).alias("z"))


def nu_normalised(ds: CountDataset) -> DataFrame:
    """Counts divided by the efficiency of their cell."""
    nu = maybe_broadcast(ds.cells.select("cell", "nu"), ds.n_cells)
    return ds.counts.join(nu, "cell").select("gene", "cell", (F.col("n") * (1 / F.col("nu"))).alias("value"))


def log_normalised(ds: CountDataset) -> DataFrame:
    """log10(1 + 10000 n / size)."""
    size = maybe_broadcast(cell_sizes(ds).select("cell", "size"), ds.n_cells)
    return ds.counts.join(size, "cell").select("gene", "cell", (F.log1p(F.col("n") * 1e4 / F.col("size")) / F.log(F.lit(10.0))).alias("value"))


def normalised(ds: CountDataset, log: bool = False) -> DataFrame:
    """Counts over the efficiency of their cell, or their logarithm."""
    return log_normalised(ds) if log else nu_normalised(ds)


def dense_grid(ds: CountDataset, genes: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """``gene, cell, lambda, dispersion, nu, n, z`` of every pair: genes by cells rows by definition."""
    g = (genes if genes is not None else ds.genes).select("gene", "lambda", "dispersion")
    c = (cells if cells is not None else ds.cells).select("cell", "nu")
    grid = g.crossJoin(maybe_broadcast(c, ds.n_cells)).join(ds.counts, ["gene", "cell"], "left")
    return grid.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("z", F.signum("n").cast("int"))


def probabilities(ds: CountDataset) -> DataFrame:
    """``gene, cell, z, n, p0``: the model's probability of a zero beside what was seen."""
    p0 = probability_of_zero(F.col("dispersion"), F.col("lambda") * F.col("nu"))
    return dense_grid(ds).select("gene", "cell", "z", "n", "nu", p0.alias("p0"))


#: Values that a batch of dense rows has at most, and that a task keeps of efficiencies met before; cells of a run, rows of a task.
DENSE_VALUES, DENSE_KEPT, DENSE_RUN, DENSE_ROWS = 250_000, 4_000_000, 1024, 32_000_000


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Half away from zero, without negative zeros."""
    if digits is None:
        return x
    return np.trunc(x * 10.0**digits + np.copysign(0.5, x)) / 10.0**digits + 0.0


def dense_rows(ds: CountDataset, cells: DataFrame, genes: pa.Table, of: Callable[[np.ndarray], tuple], name: str) -> DataFrame:
    """``gene, cell, name`` of every pair: ``of(nu)`` gives a cell's values of genes that it lacks, and of those in its list ``own``.

    Cells of one efficiency have the same two rows of values, so these are made once in a task. Cells of like efficiency
    come together, and their rows gene by gene: runs of one gene and one value take next to no space when written.
    """
    names, n = genes.column("gene").combine_chunks(), genes.num_rows
    # lists are short and dense rows are not: as many tasks as the rows need, whatever the lists' size
    parts = max(ds.spark.sparkContext.defaultParallelism, min(n * ds.n_cells // 4_000_000, max(600, n * ds.n_cells // DENSE_ROWS)))
    few, run, most = max(1, DENSE_KEPT // max(1, n)), DENSE_RUN, DENSE_VALUES

    def rows(some: pa.RecordBatch, known: dict) -> Iterator[pa.RecordBatch]:
        nu, back = np.unique(some.column("nu").to_numpy(zero_copy_only=False).astype(float), return_inverse=True)
        if len(known) + len(nu) > few:
            known.clear()
        values = nu.tolist()
        for x in values:
            if x not in known:
                known[x] = of(x)
        m, made, own = some.num_rows, [known[x] for x in values], None
        if "own" in some.schema.names:
            lists = some.column("own")
            at, gene = np.repeat(np.arange(m), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(gene, kind="stable")
            at, own = at[order], gene[order]
        step = max(1, most // m)
        cell = some.column("cell").take(pa.array(np.tile(np.arange(m), min(step, n))))
        for low in range(0, n, step):
            high = min(n, low + step)
            out = np.stack([v[0][low:high] for v in made], axis=1)[:, back]
            if own is not None:
                here = slice(*np.searchsorted(own, (low, high)))
                for u in np.unique(back[at[here]]):
                    mine = back[at[here]] == u
                    i, j = own[here][mine], at[here][mine]
                    out[i - low, j] = made[u][1][i]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(low, high), m))), cell.slice(0, (high - low) * m), pa.array(out.ravel())], ["gene", "cell", name])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            nu = batch.column("nu").to_numpy(zero_copy_only=False).astype(float)
            order = np.argsort(nu, kind="stable")
            batch = batch.take(pa.array(order))
            kind = np.unique(nu[order], return_inverse=True)[1]
            k = 0
            while k < len(kind):  # so many cells, and so few efficiencies, that their values fit
                end = min(k + run, int(np.searchsorted(kind, kind[k] + few)))
                yield from rows(batch.slice(k, end - k), known)
                k = end

    kinds = [table.schema[c].dataType.simpleString() for table, c in ((ds.genes, "gene"), (ds.cells, "cell"))]
    return cells.repartitionByRange(min(parts, 20_000), "nu", "cell").mapInArrow(make, f"gene {kinds[0]}, cell {kinds[1]}, {name} double")


def by_cells(ds: CountDataset, value: Callable[[np.ndarray, np.ndarray], np.ndarray], digits: int | None = None) -> DataFrame | None:
    """``gene, cell, value`` of every pair, ``value(p0, seen)`` by numpy; None where there are too many genes to send along.

    A cell comes with the list of its genes, so the dense rows are made in one pass and never shuffled.
    """
    if ds.n_genes > SMALL:
        return None
    table = ds.genes.orderBy("pos").select("gene", "lambda", "dispersion").toArrow()
    lam, a = (table.column(c).to_numpy().astype(float) for c in ("lambda", "dispersion"))
    at = ds.spark.createDataFrame(pa.table({"gene": table.column("gene").combine_chunks(), "i": pa.array(np.arange(len(lam), dtype=np.int32))}))
    lists = ds.counts.join(F.broadcast(at), "gene").groupBy("cell").agg(F.collect_list("i").alias("own"))

    def of(nu: float) -> tuple:
        p0 = zero_probability(a, nu * lam)
        return tuple(rounded(value(p0, np.full(len(p0), seen)), digits) for seen in (False, True))

    return dense_rows(ds, ds.cells.select("cell", "nu").join(lists, "cell", "left"), table, of, "value")


FORMULAS = ("raw", "log", "der", "sLog")


def _formula(formula: str):
    """A likelihood's formula over arrays."""

    def value(p0: np.ndarray, seen: np.ndarray) -> np.ndarray:
        p = np.maximum(np.minimum(p0, 1 - 1e-8), 1e-8)
        if formula == "raw":
            return np.where(seen, 1 - p, p)
        if formula == "der":
            return np.where(seen, -1 / (1 - p), 1 / p)
        return np.where(seen, (1 if formula == "log" else -1) * np.log1p(-p), np.log(p))

    return value


def likelihood(ds: CountDataset, formula: str = "raw", digits: int | None = None) -> DataFrame:
    """``gene, cell, value``: likelihood of what was seen, its logarithm, derivative or signed logarithm; rounded if asked for."""
    if formula not in FORMULAS:
        raise ValueError(f"unknown formula {formula}")
    if (made := by_cells(ds, _formula(formula), digits)) is not None:
        return made
    p = F.greatest(F.least(F.col("p0"), F.lit(1 - 1e-8)), F.lit(1e-8))
    seen, other = {
        "raw": (1 - p, p),
        "log": (F.log1p(-p), F.log(p)),
        "der": (-1 / (1 - p), 1 / p),
        "sLog": (-F.log1p(-p), F.log(p)),
    }[formula]
    out = F.when(F.col("z") == 1, seen).otherwise(other)
    return probabilities(ds).select("gene", "cell", (out if digits is None else F.round(out, digits) + F.lit(0.0)).alias("value"))


#: The names of each data method, full and short.
METHODS = {
    "raw": ("RW", "Raw", "RawData"),
    "nu": ("NN", "NuNorm", "Normalized"),
    "log": ("LN", "LogNorm", "LogNormalized"),
    "binary": ("BI", "Bin", "Binarized"),
    "discrepancy": ("BD", "BinDiscr", "BinarizedDiscrepancy"),
    "adjusted": ("AB", "AdjBin", "AdjBinarized"),
    "likelihood": ("LH", "Like", "Likelihood"),
    "log_likelihood": ("LL", "LogLike", "LogLikelihood"),
    "derivative": ("DL", "DerLogL", "DerivativeLogLikelihood"),
    "signed": ("SL", "SignLogL", "SignedLogLikelihood"),
}


def data_matrix(ds: CountDataset, method: str = "", digits: int | None = None) -> DataFrame:
    """``gene, cell, value`` by the named method; sparse methods return only what is not zero. Rounded if asked for."""
    method = method or "LogNormalized"
    kind = next((k for k, names in METHODS.items() if method == k or method in names), None)
    if kind is None:
        raise ValueError(f"unknown data method {method}")
    short = lambda rows: rows if digits is None else rows.select("gene", "cell", (F.round("value", digits) + F.lit(0.0)).alias("value"))
    if kind == "raw":
        return short(ds.counts.select("gene", "cell", F.col("n").cast("double").alias("value")))
    if kind == "binary":
        return short(ds.counts.select("gene", "cell", F.lit(1.0).alias("value")))
    if kind in ("nu", "log"):
        return short(nu_normalised(ds) if kind == "nu" else log_normalised(ds))
    if kind in ("discrepancy", "adjusted"):
        value = (lambda p0, seen: np.where(seen, p0, p0 - 1)) if kind == "discrepancy" else (lambda p0, seen: np.where(seen, p0, 1 - p0))
        if (made := by_cells(ds, value, digits)) is not None:
            return made
        zero = F.col("p0") - 1 if kind == "discrepancy" else 1 - F.col("p0")
        return short(probabilities(ds).select("gene", "cell", F.when(F.col("z") == 1, F.col("p0")).otherwise(zero).alias("value")))
    return likelihood(ds, {"likelihood": "raw", "log_likelihood": "log", "derivative": "der", "signed": "sLog"}[kind], digits)


def drop_genes_cells(ds: CountDataset, genes: list | DataFrame | None = None, cells: list | DataFrame | None = None) -> CountDataset:
    """Without some genes and cells; estimates, flags and pair tables go. Unknown names and empty rests raise."""
    gone = {}
    for key, given, table in (("gene", genes, ds.genes), ("cell", cells, ds.cells)):
        if given is None or (isinstance(given, list) and not given):
            continue
        frame = ds.spark.createDataFrame([(x,) for x in given], f"{key} {table.schema[key].dataType.simpleString()}") if isinstance(given, list) else given.select(key)
        if frame.join(table.select(key), key, "left_anti").limit(1).count():  # other columns would meet those that the names came with
            raise ValueError(f"unknown {key} to drop")
        gone[key] = frame.distinct()
    if not gone:
        return ds
    out = {"genes": ds.genes.drop("fe_genes", "lambda", "dispersion", "gdi"), "cells": ds.cells.drop("fe_cells", "nu")}
    counts = ds.counts
    for key, frame in gone.items():
        counts = counts.join(frame, key, "left_anti")
        out[f"{key}s"] = out[f"{key}s"].join(frame, key, "left_anti")
    made = replace(ds, counts=counts, genes=out["genes"], cells=out["cells"], gene_coex=None, cell_coex=None, cluster_coex=dict.fromkeys(ds.cluster_coex))
    made = replace(made, n_genes=made.genes.count(), n_cells=made.cells.count())
    if not (made.n_genes and made.n_cells):
        raise ValueError("nothing would be left")
    return made.out_of_sync() if ds.meta else made


def flag_fully_expressed(ds: CountDataset, cells_threshold: float = 0.99, genes_threshold: float = 0.99) -> CountDataset:
    """``fe_genes`` and ``fe_cells``: expressed in (nearly) all cells, expressing (nearly) all genes."""
    g = expressing_cells(ds).select("gene", (F.col("n_cells") >= cells_threshold * ds.n_cells).alias("fe_genes"))
    c = expressed_genes(ds).select("cell", (F.col("n_genes") >= genes_threshold * ds.n_genes).alias("fe_cells"))
    return ds.with_gene_columns(g).with_cell_columns(c)


def not_fully_expressed(ds: CountDataset) -> DataFrame:
    """``gene, flag``: true unless the gene is flagged as fully expressed; without flags all are true."""
    return ds.genes.select("gene", (~F.col("fe_genes") if "fe_genes" in ds.genes.columns else F.lit(True)).alias("flag"))


def not_fully_expressing(ds: CountDataset) -> DataFrame:
    """``cell, flag``: true unless the cell is flagged as fully expressing."""
    return ds.cells.select("cell", (~F.col("fe_cells") if "fe_cells" in ds.cells.columns else F.lit(True)).alias("flag"))


def fully_expressed(ds: CountDataset) -> DataFrame:
    """``gene`` of the flagged genes."""
    return not_fully_expressed(ds).where(~F.col("flag")).select("gene")


def fully_expressing(ds: CountDataset) -> DataFrame:
    """``cell`` of the flagged cells."""
    return not_fully_expressing(ds).where(~F.col("flag")).select("cell")


def _round_even(x: float) -> int:
    return int(round(x))


def clean(ds: CountDataset, cells_cutoff: float = 0.003, genes_cutoff: float = 0.002, cells_threshold: float = 0.99, genes_threshold: float = 0.99) -> CountDataset:
    """Drops genes of too few cells, then cells of too few genes among those left; flags, and fits nu."""
    from tessera.operators.model import estimate_nu

    # what goes and what stays is written out: several jobs read each of them
    few = checkpoint(expressing_cells(ds).where(F.col("n_cells") <= _round_even(ds.n_cells * cells_cutoff)))
    if few.limit(1).count():
        ds = settled(drop_genes_cells(ds, genes=few))
    few = checkpoint(expressed_genes(ds).where(F.col("n_genes") <= _round_even(ds.n_genes * genes_cutoff)))
    if few.limit(1).count():
        ds = settled(drop_genes_cells(ds, cells=few))
    return estimate_nu(flag_fully_expressed(ds, cells_threshold, genes_threshold))


def names_subset(table: DataFrame, key: str, wanted: list | None = None) -> DataFrame:
    """The rows of some names in the table's order; none given means all, unknown ones raise."""
    if not wanted:
        return table.orderBy("pos")
    found = table.where(F.col(key).isin(list(wanted)))
    if found.count() != len(set(wanted)):
        raise ValueError(f"unknown {key}")
    return found.orderBy("pos")

