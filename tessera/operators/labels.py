"""Clusterizations and conditions: names, lists, merges, levels."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.dataset import CountDataset, maybe_broadcast

CLUSTER, CONDITION, NO_CONDITION, UNCLUSTERED = "CL_", "COND_", "NoCond", "-1"


def _full(name: str, prefix: str) -> str:
    return name if name.startswith(prefix) else prefix + name


def add_labels(ds: CountDataset, name: str, labels: DataFrame, prefix: str = CLUSTER, scores: DataFrame | None = None, override: bool = False) -> CountDataset:
    """Adds a column of labels ``cell, cluster`` (or ``cell, condition``) for exactly the dataset's cells."""
    full = _full(name, prefix)
    if full == prefix:
        raise ValueError("a name is needed")
    if full in ds.cells.columns and not override:
        raise ValueError(f"{full} is there already")
    value = next(c for c in labels.columns if c != "cell")
    n, distinct = labels.agg(F.count(F.lit(1)), F.countDistinct("cell")).first()
    if not n == distinct == ds.n_cells or labels.join(ds.cells.select("cell"), "cell", "left_anti").limit(1).count():
        raise ValueError("labels must cover exactly the cells of the dataset")
    out = ds.with_cell_columns(labels.select("cell", F.col(value).cast("string").alias(full)))
    return replace(out, cluster_coex={k: v for k, v in out.cluster_coex.items() if k != full} | {full: scores}) if prefix == CLUSTER else out


def add_scores(ds: CountDataset, name: str, scores: DataFrame) -> CountDataset:
    """Attaches a DEA table to a clusterization."""
    full = _full(name, CLUSTER)
    if full not in ds.cells.columns:
        raise ValueError(f"no clusterization {full}")
    if scores.select("cluster").distinct().join(ds.cells.select(F.col(full).alias("cluster")).distinct(), "cluster", "left_anti").limit(1).count():
        raise ValueError("scores of unknown clusters")
    return replace(ds, cluster_coex=ds.cluster_coex | {full: scores})


def drop_labels(ds: CountDataset, name: str, prefix: str = CLUSTER) -> CountDataset:
    full = _full(name, prefix)
    if full not in ds.cells.columns:
        raise ValueError(f"no column {full}")
    return replace(ds, cells=ds.cells.drop(full), cluster_coex={k: v for k, v in ds.cluster_coex.items() if k != full})


def label_names(ds: CountDataset, prefix: str = CLUSTER, keep_prefix: bool = False, with_scores: bool = False) -> list[str]:
    found = [c for c in ds.cells.columns if c.startswith(prefix) and not (with_scores and ds.cluster_coex.get(c) is None)]
    return found if keep_prefix else [c[len(prefix) :] for c in found]


def label_name(ds: CountDataset, name: str = "", prefix: str = CLUSTER) -> str:
    """The full name; by default of the labels added last."""
    known = label_names(ds, prefix, keep_prefix=True)
    if not name and known:
        return known[-1]
    if not name or _full(name, prefix) not in known:
        raise ValueError(f"no labels {name!r}")
    return _full(name, prefix)


def get_labels(ds: CountDataset, name: str = "", prefix: str = CLUSTER) -> DataFrame:
    """``cell, cluster`` or ``cell, condition``; without any condition all cells are ``NoCond``."""
    value = "cluster" if prefix == CLUSTER else "condition"
    if prefix == CONDITION and not name and not label_names(ds, prefix):
        return ds.cells.select("cell", F.lit(NO_CONDITION).alias(value))
    return ds.cells.select("cell", F.col(label_name(ds, name, prefix)).alias(value))


def get_scores(ds: CountDataset, name: str = "") -> DataFrame | None:
    return ds.cluster_coex.get(label_name(ds, name))


def to_lists(clusters: DataFrame) -> DataFrame:
    """``cluster, elements``: sorted members of each cluster."""
    return clusters.groupBy("cluster").agg(F.sort_array(F.collect_list("cell")).alias("elements"))


def from_lists(lists: DataFrame, cells: DataFrame | None = None, throw_on_overlap: bool = True) -> DataFrame:
    """``cluster, elements`` -> ``cell, cluster``; cells in no list get -1, the last list wins an overlap.

    The order of the lists is that of a column ``pos`` if there is one, else of the clusters' names.
    """
    order = F.col("pos") if "pos" in lists.columns else F.col("cluster")
    rows = lists.select("cluster", order.alias("_order"), F.explode("elements").alias("cell"))
    if throw_on_overlap and rows.groupBy("cell").count().where("count > 1").limit(1).count():
        raise ValueError("clusters overlap")
    one = rows.groupBy("cell").agg(F.max_by("cluster", "_order").alias("cluster"))
    return one if cells is None else cells.select("cell").join(one, "cell", "left").select("cell", F.coalesce("cluster", F.lit(UNCLUSTERED)).alias("cluster"))


def as_clusterization(labels: DataFrame | dict, ds: CountDataset | None = None, spark=None) -> DataFrame:
    """``cell, cluster`` (strings) from a dict or from any two columns, in this order.

    With a dataset the cells must be exactly its own.
    """
    if isinstance(labels, dict):
        if not labels:
            raise ValueError("no labels given")
        session = spark or (ds.spark if ds else None)
        labels = session.createDataFrame([(c, str(v)) for c, v in labels.items()], ["cell", "cluster"])
    if len(labels.columns) != 2:
        raise ValueError("labels have two columns: names and clusters")
    out = labels.toDF("cell", "cluster").withColumn("cluster", F.col("cluster").cast("string"))
    if ds is not None:
        n, distinct = out.agg(F.count(F.lit(1)), F.countDistinct("cell")).first()
        if not n == distinct == ds.n_cells or out.join(ds.cells.select("cell"), "cell", "left_anti").limit(1).count():
            raise ValueError("labels must cover exactly the cells of the dataset")
    return out


def name_and_labels(ds: CountDataset, name: str = "", labels: DataFrame | dict | None = None, prefix: str = CLUSTER) -> tuple[str, DataFrame]:
    """(name, labels): those given, checked, or else the dataset's own of that name, the last by default."""
    if labels is None:
        if prefix == CONDITION and not name and not label_names(ds, prefix):
            return NO_CONDITION, get_labels(ds, name, prefix)
        return label_name(ds, name, prefix), get_labels(ds, name, prefix)
    made = as_clusterization(labels, ds)
    return name or "DummyName", made if prefix == CLUSTER else made.withColumnRenamed("cluster", "condition")


def grouped_positions(clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """``cell, cluster, place``: cells in order of their clusters, those without at the end."""
    rows = cells.select("cell", "pos").join(clusters, "cell", "left").withColumn("cluster", F.coalesce("cluster", F.lit(UNCLUSTERED)))
    place = F.row_number().over(W.orderBy(F.col("cluster") == UNCLUSTERED, "cluster", "pos"))
    return rows.select("cell", "cluster", place.alias("place"))


def merge_clusters(clusters: DataFrame, names: list[str], merged: str = "") -> DataFrame:
    """Clusters of these names under one; fewer than two of them leave all as it is, with a warning."""
    present = [r["cluster"] for r in clusters.where(F.col("cluster").isin(names)).select("cluster").distinct().collect()]
    if len(present) < 2:
        warnings.warn("nothing to merge", stacklevel=2)
        return clusters
    merged = merged or "_".join(sorted(names)) + "-merge"
    return clusters.withColumn("cluster", F.when(F.col("cluster").isin(names), F.lit(merged)).otherwise(F.col("cluster")))


def multi_merge(clusters: DataFrame, names: list[list[str]], merged: list[str] | None = None) -> DataFrame:
    for i, group in enumerate(names):
        clusters = merge_clusters(clusters, group, merged[i] if merged else "")
    return clusters


def condition_from_name(names: DataFrame, column: str = "cell", pattern: str = " ", fragment: int = 2) -> DataFrame:
    """Adds ``condition``: a fragment of each name; all ``1`` where a fragment is missing or all differ."""
    part = F.get(F.split(F.col(column), pattern), F.lit(fragment - 1))
    found = names.withColumn("condition", part)
    n, have, distinct = found.agg(F.count(F.lit(1)), F.count("condition"), F.countDistinct("condition")).first()
    return found if have == n and distinct < n else names.withColumn("condition", F.lit("1"))


def nice_levels(values: DataFrame, column: str) -> DataFrame:
    """Adds ``level``: whole numbers padded with zeros to one width, other labels with underscores."""
    text = F.col(column).cast("string")
    whole, width = values.agg(F.bool_and(text.rlike("^-?[0-9]+$")), F.max(F.length(text))).first()
    pad: Column = F.lpad(text, int(width or 1), "0" if whole else "_")
    return values.withColumn("level", pad)


def renumber(clusters: DataFrame) -> DataFrame:
    """Clusters in the order of their names under numbers of equal width; -1 stays."""
    real = clusters.where(F.col("cluster") != UNCLUSTERED).select("cluster").distinct()
    n = real.count()
    width = max(1, len(str(n)))
    names = real.select("cluster", F.lpad(F.row_number().over(W.orderBy("cluster")).cast("string"), width, "0").alias("new"))
    return clusters.join(maybe_broadcast(names, n), "cluster", "left").select("cell", F.coalesce("new", "cluster").alias("cluster"))
