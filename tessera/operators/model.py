"""Estimates: rate and dispersion of each gene, efficiency of each cell.

The zero probability of a gene in a cell depends on the cell only through its efficiency, so every sum
over cells is a sum over the distinct efficiencies with their multiplicities (``histogram``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.algos.solvers import dispersion_bisection, dispersion_newton, fit_zeros, nu_bisection
from tessera.dataset import SMALL, CountDataset, checkpoint, maybe_broadcast
from tessera.operators.raw import cell_sizes, dense_rows, expressed_genes, expressing_cells, gene_sizes, rounded

#: More distinct efficiencies than this do not go into a closure.
MOST_VALUES = 500_000
#: Pairs of a gene and a cell that the joint fit holds at most (2 GB with its work space).
MOST_PAIRS = 20_000_000
#: Efficiencies that are interpolated at once.
SLICE = 65_536


def estimate_lambda(ds: CountDataset) -> CountDataset:
    """Mean count of each gene over all cells."""
    return _changed(ds.with_gene_columns(gene_sizes(ds).select("gene", (F.col("size") / ds.n_cells).alias("lambda"))))


def estimate_nu(ds: CountDataset) -> CountDataset:
    """Size of each cell over the mean size."""
    sizes = cell_sizes(ds)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    mean = total / max(ds.n_cells, 1)
    return _changed(ds.with_cell_columns(sizes.select("cell", (F.col("size") / F.lit(float(mean or 1))).alias("nu"))))


def nu_by_cluster(ds: CountDataset, clusters: DataFrame) -> CountDataset:
    """Size of each cell over the mean size of its cluster; ``clusters(cell, cluster)``."""
    sizes = cell_sizes(ds).join(clusters, "cell")
    means = sizes.groupBy("cluster").agg(F.avg("size").alias("mean"))
    return _changed(ds.with_cell_columns(sizes.join(means, "cluster").select("cell", (F.col("size") / F.col("mean")).alias("nu"))))


def _changed(ds: CountDataset) -> CountDataset:
    return ds.out_of_sync() if ds.meta else ds


def histogram(ds: CountDataset) -> pd.DataFrame:
    """``nu, m``: the distinct efficiencies and how many cells have each, in order."""
    values = ds.cells.groupBy("nu").agg(F.count(F.lit(1)).alias("m")).orderBy("nu").limit(MOST_VALUES + 1).toPandas()
    if len(values) > MOST_VALUES:
        raise ValueError("more distinct efficiencies than one task should hold; round nu first")
    return values


#: Chebyshev nodes that stand for the efficiencies of an octave.
NODES = 24


def nodes(nu: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(efficiencies, weights) that sum zero probabilities, and products of two, as the given ones do, to rounding.

    As functions of the efficiency these are analytic right of 0 and at most 1 there, so in an octave
    their interpolation at n Chebyshev nodes is off by less than 5.8^-n. An octave with many distinct
    efficiencies gives the nodes the weights of its interpolation, others are left as they are.
    """
    octave = np.full(len(nu), np.iinfo(np.int64).min)
    fine = np.isfinite(nu) & (nu > 0)
    octave[fine] = np.floor(np.log2(nu[fine])).astype(np.int64)
    at = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
    bary = np.sin((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)) * (-1.0) ** np.arange(NODES)
    values, weights = [], []
    for o in np.unique(octave):
        own = octave == o
        x, k = nu[own], m[own]
        if len(x) <= 4 * NODES or not fine[own].all():
            values.append(x)
            weights.append(k)
            continue
        mid, half = (x.min() + x.max()) / 2, (x.max() - x.min()) / 2
        total = np.zeros(NODES)
        for s in range(0, len(x), SLICE):
            gap = ((x[s : s + SLICE] - mid) / half)[:, None] - at[None]
            exact = gap == 0
            share = bary / np.where(exact, 1.0, gap)
            share = np.where(exact.any(1, keepdims=True), exact.astype(float), share)
            total += k[s : s + SLICE] @ (share / share.sum(1, keepdims=True))
        values.append(mid + half * at[::-1])
        weights.append(total[::-1])
    return np.concatenate(values) if values else nu, np.concatenate(weights) if weights else m


def estimate_dispersion(ds: CountDataset, threshold: float = 1e-3, max_iterations: int = 100, chunk: int = 1024) -> CountDataset:
    """Dispersion of each gene by Newton's method; genes that fail are solved by bisection."""
    values = histogram(ds)
    nu, m = nodes(values["nu"].to_numpy(float), values["m"].to_numpy(float))
    chunk = max(1, min(chunk, 8_000_000 // max(1, len(nu))))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), chunk):
                part = batch.iloc[at : at + chunk]
                lam, zeros = part["lambda"].to_numpy(float), part["zeros"].to_numpy(float)
                found = dispersion_newton(lam, zeros, nu, m, threshold, max_iterations, strict=False)
                if (lost := np.isnan(found)).any():
                    found[lost] = dispersion_bisection(lam[lost], zeros[lost], nu, m, threshold, max_iterations)
                yield pd.DataFrame({"gene": part["gene"], "dispersion": found})

    zeros = expressing_cells(ds).join(ds.genes.select("gene", "lambda"), "gene").select("gene", "lambda", (F.lit(ds.n_cells) - F.col("n_cells")).alias("zeros"))
    kind = ds.genes.schema["gene"].dataType.simpleString()
    return _changed(ds.with_gene_columns(checkpoint(zeros.mapInPandas(solve, f"gene {kind}, dispersion double"))))


#: The name under which the bisection estimate is known; it runs Newton's method too.
estimate_dispersion_bisection = estimate_dispersion


def estimate_nu_bisection(ds: CountDataset, threshold: float = 1e-3, max_iterations: int = 100) -> CountDataset:
    """Efficiency of each cell from rates and dispersions. Equal cells (zeros, guess) are solved once."""
    genes = ds.genes.groupBy("lambda", "dispersion").agg(F.count(F.lit(1)).alias("m")).limit(MOST_VALUES + 1).toPandas()
    if len(genes) > MOST_VALUES:
        raise ValueError("more distinct genes than one task should hold")
    lam, a = np.repeat(genes["lambda"].to_numpy(float), genes["m"]), np.repeat(genes["dispersion"].to_numpy(float), genes["m"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(new=nu_bisection(b["zeros"], lam, a, b["nu"], threshold, max_iterations))

    zeros = expressed_genes(ds).join(ds.cells.select("cell", "nu"), "cell").select("cell", (F.lit(ds.n_genes) - F.col("n_genes")).cast("double").alias("zeros"), "nu")
    solved = zeros.select("zeros", "nu").distinct().mapInPandas(solve, "zeros double, nu double, new double")
    return _changed(ds.with_cell_columns(checkpoint(zeros.join(solved, ["zeros", "nu"]).select("cell", F.col("new").alias("nu")))))


def estimate_dispersion_nu(ds: CountDataset, threshold: float = 1e-3, max_iterations: int = 100, average_to_one: bool = True) -> CountDataset:
    """Dispersions and efficiencies in turn, at a tenth of the threshold, until the zeros of genes fit."""
    for _ in range(max_iterations):
        ds = estimate_nu_bisection(estimate_dispersion(ds, threshold / 10), threshold / 10)
        mean, infinite = ds.cells.agg(F.avg("nu"), F.max(F.col("nu") == float("inf"))).first()
        if average_to_one and not infinite:
            ds = ds.with_cell_columns(ds.cells.select("cell", (F.col("nu") / F.lit(mean)).alias("nu")))
        ds = ds.with_cell_columns(checkpoint(ds.cells.select("cell", "nu")))
        error = expected_zeros(ds).join(expressing_cells(ds), "gene").agg(F.max(F.abs(F.lit(ds.n_cells) - F.col("n_cells") - F.col("zeros")))).first()[0]
        if error < threshold and (infinite or not average_to_one or abs(mean - 1) < threshold):
            return ds
    raise ArithmeticError("no convergence")


def estimate_dispersion_nu_joint(ds: CountDataset, threshold: float = 1e-3, max_iterations: int = 50, average_to_one: bool = True) -> CountDataset:
    """Dispersions and efficiencies together: least squares of the zeros of genes and of cells, step by step.

    The error is the root mean square of expected less observed zeros, over genes, cells and, if asked
    for, the mean efficiency less 1. Every gene needs a cell without it and every cell a missing gene.
    Genes and cells move in turn, each by its own equation with exact slopes; a step is halved until the error
    falls. The fit is dense and on the driver: genes times cells is checked.
    """
    if "lambda" not in ds.genes.columns:
        raise ValueError("estimate lambda first")
    if ds.n_genes * ds.n_cells > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of a gene and a cell: use estimate_dispersion_nu")
    if "nu" not in ds.cells.columns:
        ds = estimate_nu(ds)
    genes = expressing_cells(ds).join(ds.genes.select("gene", "lambda"), "gene").toPandas()
    cells = expressed_genes(ds).join(ds.cells.select("cell", "nu"), "cell").toPandas()
    zero_genes, zero_cells = (ds.n_cells - genes["n_cells"]).to_numpy(float), (ds.n_genes - cells["n_genes"]).to_numpy(float)
    if not (zero_genes > 0).all() or not (zero_cells > 0).all():
        raise ValueError("a gene is in every cell, or a cell has every gene")
    a, nu = fit_zeros(genes["lambda"].to_numpy(float), zero_genes, zero_cells, cells["nu"].to_numpy(float), threshold, max_iterations, average_to_one)
    put = lambda key, names, name, v: ds.spark.createDataFrame(pd.DataFrame({key: names, name: v}))
    out = ds.with_gene_columns(put("gene", genes["gene"], "dispersion", a)).with_cell_columns(put("cell", cells["cell"], "nu", nu))
    return _changed(out)


def expected_zeros(ds: CountDataset) -> DataFrame:
    """``gene, zeros``: expected number of cells without the gene."""
    from tessera.functions.special import probability_of_zero

    values = ds.cells.groupBy("nu").agg(F.count(F.lit(1)).alias("m"))
    p0 = probability_of_zero(F.col("dispersion"), F.col("lambda") * F.col("nu"))
    return ds.genes.select("gene", "lambda", "dispersion").crossJoin(maybe_broadcast(values, ds.n_cells)).groupBy("gene").agg(F.sum(F.col("m") * p0).alias("zeros"))


def set_estimate(ds: CountDataset, name: str, table: DataFrame) -> CountDataset:
    """Sets ``lambda``, ``dispersion`` (by gene) or ``nu`` (by cell); the table must cover all names."""
    key, n = ("cell", ds.n_cells) if name == "nu" else ("gene", ds.n_genes)
    known = ds.cells if key == "cell" else ds.genes
    if table.count() != n or table.join(known.select(key), key, "left_anti").limit(1).count() or table.select(key).distinct().count() != n:
        raise ValueError(f"{name} needs one value a {key} of the dataset")
    put = ds.with_cell_columns if key == "cell" else ds.with_gene_columns
    return _changed(put(table.select(key, name)))


def estimators_ready(ds: CountDataset) -> bool:
    return {"lambda", "dispersion"} <= set(ds.genes.columns) and "nu" in ds.cells.columns


def mu(ds: CountDataset, digits: int | None = None) -> DataFrame:
    """``gene, cell, mu``: expected counts of all pairs; rounded if asked for. Products are made once for each efficiency of a task."""
    if ds.n_genes > SMALL:
        product = F.col("lambda") * F.col("nu")
        value = product if digits is None else F.round(product, digits) + F.lit(0.0)
        return ds.genes.select("gene", "lambda").crossJoin(ds.cells.select("cell", "nu")).select("gene", "cell", value.alias("mu"))
    genes = ds.genes.orderBy("pos").select("gene", "lambda").toArrow()
    lam = genes.column("lambda").to_numpy().astype(float)
    return dense_rows(ds, ds.cells.select("cell", "nu"), genes, lambda nu: (rounded(lam * nu, digits),), "mu")
