"""Queries of accessors, labels, imports and round trips, on the matrix of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.dataset import CountDataset, checkpoint
from tessera.operators import labels as L
from tessera.operators import model as M
from tessera.operators import pairs as P
from tessera.operators import raw as R
from tessera.operators import scores as S
from tessera.operators import uniformity as U
from tessera.queries.matrix import BASE, CELL_SQL, CELLS, GENES, PAIRS, SUBSET, brands, counts, dataset, fitted, gdi_sql, linear, r6, types
from tessera.sources import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, parts: str = "", base: str = BASE):
    """Registers a query under its name, and its SQL after the common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = (base + parts + "done AS (SELECT 1) " if base else "") + sql
        return f

    return add


@query(f"SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS pos FROM gs QUALIFY gene IN {SUBSET}")
def names_subset(spark: SparkSession, sf: str) -> DataFrame:
    return R.names_subset(dataset(spark, sf).genes, "gene", GENES).select("gene", "pos")


@query("SELECT unnest(['raw', 'genesCoex', 'cellsCoex']) AS name, unnest([g, g, 0])::BIGINT AS n_rows, unnest([c, g, 0])::BIGINT AS n_columns FROM dim")
def dims(spark: SparkSession, sf: str) -> DataFrame:
    ds = P.calculate_coex(fitted(spark, sf))
    return spark.createDataFrame([(k, *v) for k, v in ds.dims().items() if k in ("raw", "genesCoex", "cellsCoex")], "name string, n_rows long, n_columns long")


@query("SELECT gene, cell, round(log10(1 + n * 10000 / size), 6) AS value FROM counts JOIN cs USING (cell)")
def normalised_log(spark: SparkSession, sf: str) -> DataFrame:
    return R.normalised(linear(spark, sf), log=True).select("gene", "cell", r6("value").alias("value"))


@query("SELECT gene, n_cells < 0.26 * c AS flag FROM gs, dim")
def not_fully_expressed(spark: SparkSession, sf: str) -> DataFrame:
    return R.not_fully_expressed(R.flag_fully_expressed(dataset(spark, sf), 0.26, 0.3))


@query("SELECT cell FROM cs, dim WHERE n_genes >= 0.3 * g")
def fully_expressing(spark: SparkSession, sf: str) -> DataFrame:
    return R.fully_expressing(R.flag_fully_expressed(dataset(spark, sf), 0.26, 0.3))


@query("SELECT gene, cell, round(lam * nu, 6) AS mu FROM init CROSS JOIN cells")
def mu(spark: SparkSession, sf: str) -> DataFrame:
    return M.mu(linear(spark, sf), 6)


@query("SELECT gene, round(2 * lam, 6) AS lambda, true AS ready FROM init")
def set_lambda(spark: SparkSession, sf: str) -> DataFrame:
    ds = fitted(spark, sf)
    out = M.set_estimate(ds, "lambda", ds.genes.select("gene", (2 * F.col("lambda")).alias("lambda")))
    return out.genes.select("gene", r6("lambda").alias("lambda"), F.lit(M.estimators_ready(out)).alias("ready"))


@query("SELECT x1, x2, round(CASE WHEN x1 = x2 THEN 0 ELSE coex END, 6) + 0 AS coex FROM both_", PAIRS)
def stored_genes_coex(spark: SparkSession, sf: str) -> DataFrame:
    return P.get_coex(P.calculate_coex(fitted(spark, sf))).select("x1", "x2", r6("coex").alias("coex"))


@query(
    "SELECT x1, x2, round(CASE WHEN x1 = x2 THEN 0 ELSE (o_yy - (n - n1 - n2 + nn)) * sqrt((1/greatest(1, nn) + 1/greatest(1, n1 - nn) + 1/greatest(1, n2 - nn) + 1/greatest(1, n - n1 - n2 + nn)) / n) END, 6) + 0 AS coex FROM ct",
    CELL_SQL,
)
def partial_cells_coex(spark: SparkSession, sf: str) -> DataFrame:
    return P.get_coex(fitted(spark, sf), CELLS, cells=True).select("x1", "x2", r6("coex").alias("coex"))


@query("SELECT unnest(['made', 'estimated again', 'made again', 'dropped']) AS step, unnest([true, false, true, false]) AS available", base="")
def coex_states(spark: SparkSession, sf: str) -> DataFrame:
    ds = P.calculate_coex(fitted(spark, sf).initialize_metadata("G", "m", "c"))
    again = M.estimate_lambda(ds)
    steps = [("made", ds), ("estimated again", again), ("made again", P.calculate_coex(again)), ("dropped", P.drop_coex(ds))]
    return spark.createDataFrame([(k, P.coex_available(d)) for k, d in steps], "step string, available boolean")


@query(
    f"SELECT least(x1, x2) AS a, greatest(x1, x2) AS b, o_nn::DOUBLE AS nn, o_yy::DOUBLE AS yy FROM tables WHERE x1 IN {SUBSET} AND x2 IN {SUBSET}",
    PAIRS,
)
def partial_observed_tables(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.observed_tables(fitted(spark, sf), subset=GENES).where(F.col("x1").isin(GENES) & (F.col("x1") <= F.col("x2")))
    return rows.select(F.col("x1").alias("a"), F.col("x2").alias("b"), F.col("nn").cast("double").alias("nn"), F.col("yy").cast("double").alias("yy"))


@query("SELECT gene, round(gdi, 4) AS gdi FROM gdi", PAIRS + gdi_sql())
def stored_gdi(spark: SparkSession, sf: str) -> DataFrame:
    ds = fitted(spark, sf)
    return S.store_gdi(ds, S.gdi(ds)).genes.select("gene", r6("gdi", 4).alias("gdi"))


@query(
    "SELECT unnest(['GEO:', 'scRNAseq method:', 'condition sample:', 'starting n. of cells:', 'genes'' COEX is in sync:', 'cells'' COEX is in sync:', 'note']) AS tag, unnest(['G', 'm', 'other', c::VARCHAR, 'FALSE', 'FALSE', 'x']) AS value FROM dim"
)
def metadata(spark: SparkSession, sf: str) -> DataFrame:
    ds = dataset(spark, sf).initialize_metadata("G", "m", "c").add_metadata("note", "x").add_metadata("CONDITION sample:", "other")
    return ds.metadata_frame().select("tag", F.element_at("vals", 1).alias("value"))


@query("SELECT cell, types.cluster, condition FROM types JOIN brands USING (cell)")
def stored_labels(spark: SparkSession, sf: str) -> DataFrame:
    ds = dataset(spark, sf)
    ds = L.add_labels(ds, "type", types(ds, sf))
    ds = L.add_labels(ds, "brand", brands(ds, sf), L.CONDITION)
    return L.get_labels(ds).join(L.get_labels(ds, "brand", L.CONDITION), "cell")


@query("SELECT unnest(['a', 'b', 'COND_x', 'after: b']) AS name", base="")
def label_names(spark: SparkSession, sf: str) -> DataFrame:
    ds = dataset(spark, sf)
    for name in "ab":
        ds = L.add_labels(ds, name, types(ds, sf))
    ds = L.add_labels(ds, "x", brands(ds, sf), L.CONDITION)
    after = L.label_names(L.drop_labels(ds, "a"))
    names = [*L.label_names(ds), *L.label_names(ds, L.CONDITION, keep_prefix=True), *(f"after: {n}" for n in after)]
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("SELECT cell, CASE WHEN r <= 2 THEN m12 WHEN r <= 4 THEN 'rest' ELSE cluster END AS cluster FROM types JOIN (SELECT cluster, row_number() OVER (ORDER BY cluster) AS r FROM types GROUP BY 1) USING (cluster), (SELECT string_agg(cluster, '_' ORDER BY cluster) || '-merge' AS m12 FROM (SELECT DISTINCT cluster FROM types ORDER BY 1 LIMIT 2))")
def multi_merge(spark: SparkSession, sf: str) -> DataFrame:
    ds = dataset(spark, sf)
    of = types(ds, sf)
    names = sorted(r["cluster"] for r in of.select("cluster").distinct().collect())
    return L.multi_merge(of, [names[:2], names[2:4]], ["", "rest"])


@query("SELECT cell, cluster FROM types")
def as_clusterization(spark: SparkSession, sf: str) -> DataFrame:
    ds = dataset(spark, sf)
    return L.name_and_labels(ds, labels=types(ds, sf).toDF("part", "kind"))[1]


@query(
    "SELECT 'SimpleCheck' AS class, round(avg((gdi >= 1.4)::INT), 6) AS fraction_beyond, round(quantile_cont(gdi, 0.99), 4) AS quantile_at_ratio, avg((gdi >= 1.4)::INT) <= 0.01 AS is_uniform, any_value(c)::BIGINT AS cluster_size, quantile_cont(gdi, 0.99) <= 1.6 AS passes_higher FROM gdi, dim",
    PAIRS + gdi_sql(),
)
def checker_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A checker as a table and back, and judged at a higher threshold from its quantile."""
    ds = fitted(spark, sf)
    done = U.frame_to_checks(U.checks_to_frame(spark, [U.SimpleCheck().check(S.gdi(ds), ds.n_cells)]))[0]
    higher = U.SimpleCheck().shifted(0.2).reusing(done)
    row = (type(done).__name__, done.check_.fraction_beyond, done.check_.quantile_at_ratio, done.is_uniform, done.cluster_size, higher.is_uniform)
    out = spark.createDataFrame([row], "class string, fraction_beyond double, quantile_at_ratio double, is_uniform boolean, cluster_size long, passes_higher boolean")
    return out.withColumn("fraction_beyond", r6("fraction_beyond")).withColumn("quantile_at_ratio", r6("quantile_at_ratio", 4))


@query("SELECT gene, cell, n FROM counts")
def validated_counts(spark: SparkSession, sf: str) -> DataFrame:
    return CountDataset.build(counts(spark, sf), check=True).counts


@query("SELECT p_brand AS gene, p_type AS cell, count(*) AS n FROM part GROUP BY 1, 2", base="")
def wide_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Brands by types as one row a brand, and back to long counts."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    wide = part.groupBy(F.col("p_brand").alias("gene")).pivot("p_type").count().na.fill(0)
    return CountDataset.from_wide(wide, "gene").counts


@query("SELECT gene::VARCHAR AS gene, cell::VARCHAR AS cell, n, types.cluster FROM counts JOIN types USING (cell)")
def single_cell_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    ds = dataset(spark, sf)
    made = T.to_single_cell(L.add_labels(ds, "type", types(ds, sf)))
    back = T.from_single_cell({"counts": made["counts"]}, made["genes"].drop("pos"), made["cells"].drop("pos"))
    return back.counts.join(L.get_labels(back, "type"), "cell").select("gene", "cell", "n", "cluster")


@query("SELECT x1, x2, round(coex, 6) + 0 AS coex FROM coex", PAIRS)
def legacy_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    ds = P.calculate_coex(fitted(spark, sf))
    old = T.to_legacy(ds)
    back = T.from_legacy(old["raw"], [], old["a"], old["nu"], old["lambda"], meta=old["meta"], coex=old["coex"])
    return back.gene_coex.select("x1", "x2", r6("coex").alias("coex"))


@query("SELECT gene, cell, n, p_brand AS cond FROM counts JOIN part ON p_partkey = cell")
def counts_of_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix cut by brands into datasets, and their union."""
    ds = dataset(spark, sf)
    of = checkpoint(brands(ds, sf))
    names = sorted(r["condition"] for r in of.select("condition").distinct().collect())
    own = {c: CountDataset.build(ds.counts.join(of.where(F.col("condition") == c), "cell", "left_semi"), check=False) for c in names}
    return T.union_conditions(own)
