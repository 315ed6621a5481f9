"""The count matrix as DataFrames: sparse counts in long form, with tables of genes and cells."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tags of the dataset's own metadata, in order.
DATASET_TAGS = (
    "GEO:", "scRNAseq method:", "condition sample:", "starting n. of cells:", "genes' COEX is in sync:", "cells' COEX is in sync:",
    "genes' pairs fraction with small expected count:", "cells' pairs fraction with small expected count:",
)
#: Tables of at most so many rows are joined by broadcast.
SMALL = 200_000


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the number of rows is known to be small."""
    return F.broadcast(df) if rows <= SMALL else df


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the session's checkpoint folder, ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is taken, but only on one machine: the executors of a
    cluster do not see each other's.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint(eager=True)


def validate_counts(counts: DataFrame) -> None:
    """Raises unless every count is a non-negative whole number and every name is there."""
    n = F.col("n").cast("double")
    bad = counts.agg(
        F.count_if(F.col("gene").isNull() | F.col("cell").isNull()).alias("unnamed"),
        F.count_if(n.isNull() | F.isnan(n)).alias("missing"),
        F.count_if(n < 0).alias("negative"),
        F.count_if(n != F.bround(n)).alias("broken"),
    ).first()
    if any(bad):
        raise ValueError(f"counts are not valid: {bad.asDict()}")


@dataclass(frozen=True)
class CountDataset:
    """``counts(gene, cell, n)`` with n > 0; ``genes(gene, pos, ...)``; ``cells(cell, pos, ...)``.

    Every modifier returns a changed copy. ``pos`` is the order of genes and cells; ties go by it.
    """

    counts: DataFrame
    genes: DataFrame
    cells: DataFrame
    meta: dict[str, list[str]] = field(default_factory=dict)
    gene_coex: DataFrame | None = None
    cell_coex: DataFrame | None = None
    cluster_coex: dict[str, DataFrame] = field(default_factory=dict)
    n_genes: int = -1
    n_cells: int = -1

    @classmethod
    def build(cls, counts: DataFrame, genes: DataFrame | None = None, cells: DataFrame | None = None, check: bool = True) -> CountDataset:
        """From long counts; repeated pairs are summed, zeros dropped. Order of names gives ``pos``."""
        counts = counts.select("gene", "cell", "n")
        if check:
            validate_counts(counts)
        summed = counts.groupBy("gene", "cell").agg(F.sum("n").cast("long").alias("n")).where("n > 0")
        genes = genes if genes is not None else counts.select("gene").distinct()
        cells = cells if cells is not None else counts.select("cell").distinct()
        genes, n_genes = with_position(genes, "gene")
        cells, n_cells = with_position(cells, "cell")
        made = cls(summed, genes, cells, n_genes=n_genes, n_cells=n_cells)
        if check and not (made.n_genes and made.n_cells):
            raise ValueError("a dataset needs a gene and a cell")
        return made

    @classmethod
    def from_wide(cls, wide: DataFrame, gene_col: str) -> CountDataset:
        """From one row a gene and one column a cell."""
        cells = [c for c in wide.columns if c != gene_col]
        long = wide.unpivot([gene_col], cells, "cell", "n").withColumnRenamed(gene_col, "gene")
        spark = wide.sparkSession
        order = spark.createDataFrame([(c, i) for i, c in enumerate(cells)], "cell string, pos long")
        return cls.build(long, cells=order)

    @property
    def spark(self) -> SparkSession:
        return self.counts.sparkSession

    def with_gene_columns(self, table: DataFrame) -> CountDataset:
        return replace(self, genes=_put(self.genes, table, "gene"))

    def with_cell_columns(self, table: DataFrame) -> CountDataset:
        return replace(self, cells=_put(self.cells, table, "cell"))

    def in_sync(self, cells: bool = False) -> bool:
        return (self.metadata(DATASET_TAGS[5 if cells else 4]) or [""])[0].upper() == "TRUE"

    def out_of_sync(self) -> CountDataset:
        return self.add_metadata(DATASET_TAGS[4], "FALSE").add_metadata(DATASET_TAGS[5], "FALSE")

    def add_metadata(self, tag: str, *values: object) -> CountDataset:
        """Upsert; tags are looked up without regard to case."""
        known = next((t for t in reversed(self.meta) if t.lower() == tag.lower()), tag)
        return replace(self, meta=self.meta | {known: [str(v) for v in values]})

    def metadata(self, tag: str) -> list[str]:
        return next((v for t, v in reversed(self.meta.items()) if t.lower() == tag.lower()), [""])

    def metadata_frame(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.meta.items()), "tag string, vals array<string>")

    def initialize_metadata(self, geo: str, method: str, condition: str) -> CountDataset:
        out = self
        for tag, value in zip(DATASET_TAGS, (geo, method, condition, self.n_cells, "FALSE", "FALSE"), strict=False):
            out = out.add_metadata(tag, value)
        return out

    def dims(self) -> dict[str, tuple[int, int]]:
        pairs = {"raw": (self.n_genes, self.n_cells)}
        pairs["genesCoex"] = (self.n_genes,) * 2 if self.gene_coex is not None else (0, 0)
        pairs["cellsCoex"] = (self.n_cells,) * 2 if self.cell_coex is not None else (0, 0)
        pairs["metaDataset"] = (len(self.meta), 2)
        pairs["metaGenes"] = (self.n_genes, len(self.genes.columns) - 2)
        pairs["metaCells"] = (self.n_cells, len(self.cells.columns) - 2)
        pairs["clustersCoex"] = (len(self.cluster_coex), 1)
        return pairs


def with_position(names: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(names with ``pos``, from 0 by name unless it is there, and their number).

    Up to ``SMALL`` names are numbered by one window. More are sorted by range; each partition's
    offset is the sum of the counts before it, so only a number a partition is gathered.
    """
    if "pos" in names.columns:
        return names, names.count()
    n = names.select(key).distinct().count()
    if n <= SMALL:
        return names.dropDuplicates([key]).withColumn("pos", F.row_number().over(W.orderBy(key)).cast("long") - 1), n
    part = checkpoint(names.dropDuplicates([key]).orderBy(key).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = {r["_part"]: (r["n"], r["low"]) for r in part.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("low")).collect()}
    offset, pairs = 0, []
    for p in sorted(sizes):
        here, low = sizes[p]
        pairs.append((p, offset - low))
        offset += here
    shift = names.sparkSession.createDataFrame(pairs, "_part int, _shift long")
    return part.join(F.broadcast(shift), "_part").withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift"), n


def settled(ds: CountDataset) -> CountDataset:
    """The same dataset with its tables written out, so that later steps do not repeat earlier ones."""
    return replace(ds, counts=checkpoint(ds.counts), genes=checkpoint(ds.genes), cells=checkpoint(ds.cells))


def _put(base: DataFrame, table: DataFrame, key: str) -> DataFrame:
    new = [c for c in table.columns if c != key]
    return base.drop(*new).join(table, key, "left")

