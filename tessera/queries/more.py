"""Queries that SQL can't express, or that do not use the matrix of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.dataset import CountDataset, checkpoint, settled
from tessera.operators import clusters as C
from tessera.operators import model as M
from tessera.operators import pairs as P
from tessera.operators import raw as R
from tessera.operators import scores as S
from tessera.plans import pipelines
from tessera.queries.matrix import BASE, CELL_SET, CELL_SQL, GENES, PAIRS, SUBSET, brands, dataset, fitted, p0_sql, r6, tail_sql, types
from tessera.streaming import upkeep

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf: str) -> CountDataset:
    """Genes are words of three or more letters, cells are documents; what is rare is cut by ``clean`` alone."""
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    words = rows.select(F.col("doc_id").alias("cell"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("gene")).where(F.length("gene") >= 3)
    counts = words.groupBy("gene", "cell").agg(F.count(F.lit(1)).alias("n"))
    return settled(R.clean(settled(CountDataset.build(checkpoint(counts), check=False))))


def documents_fitted(spark: SparkSession, sf: str) -> CountDataset:
    return settled(M.estimate_dispersion(M.estimate_lambda(documents(spark, sf))))


def languages(ds: CountDataset, sf: str) -> DataFrame:
    rows = ds.spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("cell"), F.col("lang").alias("cluster"))
    return ds.cells.select("cell").join(rows, "cell")


@query
def streaming_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of ``events`` kept by a streaming query, after its last batch."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    name = f"tessera_events_{abs(hash(sf))}"
    return upkeep.run_to_table(upkeep.increments(events, "event_type", "user_id"), name)


ORACLES["streaming_counts"] = "SELECT event_type AS gene, user_id AS cell, count(*) AS n FROM events GROUP BY 1, 2"


@query
def nu_bisection(spark: SparkSession, sf: str) -> DataFrame:
    return M.estimate_nu_bisection(fitted(spark, sf), 1e-8).cells.select("cell", r6("nu").alias("nu"))


#: The zeros fall with nu, so halving between the powers of two finds it; 120 steps are more than doubles tell apart.
ORACLES["nu_bisection"] = (
    BASE
    + f"""zs AS (SELECT DISTINCT g - n_genes AS zeros FROM cs, dim WHERE g > n_genes),
ns(zeros, low, high, i) AS (
  SELECT zeros, -40.0::DOUBLE, 40.0::DOUBLE, 0 FROM zs
  UNION ALL
  SELECT zeros, CASE WHEN p > zeros THEN mid ELSE low END, CASE WHEN p > zeros THEN high ELSE mid END, i + 1
  FROM (SELECT zeros, low, high, i, (low + high) / 2 AS mid, sum({p0_sql('dispersion', 'lam * pow(2, (low + high) / 2)')}) AS p
    FROM ns, genes WHERE i < 60 GROUP BY zeros, low, high, i))
SELECT cell, coalesce(round(pow(2, (low + high) / 2), 6), 'inf'::DOUBLE) AS nu FROM cs CROSS JOIN dim LEFT JOIN (SELECT * FROM ns WHERE i = 60) ON zeros = g - n_genes"""
)


@query
def dispersion_nu(spark: SparkSession, sf: str) -> DataFrame:
    ds = M.estimate_dispersion_nu(fitted(spark, sf), 1e-2)
    return M.expected_zeros(ds).join(R.expressing_cells(ds), "gene").select("gene", r6("zeros", 1).alias("expected"), (F.lit(ds.n_cells) - F.col("n_cells")).alias("seen"))


#: Converged fits expect as many zeros as were seen.
ORACLES["dispersion_nu"] = BASE + "done AS (SELECT 1) SELECT gene, (c - n_cells)::DOUBLE AS expected, c - n_cells AS seen FROM gs, dim"


@query
def reduced_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Variance of each of ten principal components over the cells."""
    rows = S.reduced_matrix(documents(spark, sf), components=10, genes="HVG_Scanpy", k=200)
    return rows.select(F.posexplode("values").alias("component", "v")).groupBy("component").agg(r6(F.variance("v"), 4).alias("variance"))


@query
def reduced_matrix_coex(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.reduced_matrix(fitted(spark, sf), use_coex=True, components=5)
    return rows.select("cell", F.size("values").alias("n"))


@query
def genes_coex_space(spark: SparkSession, sf: str) -> DataFrame:
    return S.genes_coex_space(fitted(spark, sf), GENES, 5).select("x1", "x2", r6("gcs").alias("gcs"))


#: The five nearest genes of each marker and the markers are secondary; the genes above the 0.9 quantile of the local index stay.
ORACLES["genes_coex_space"] = (
    BASE
    + PAIRS
    + f"""pm AS (SELECT s.x1, s.x2, {tail_sql('s.s')} AS p FROM s WHERE s.x2 IN {SUBSET}),
sec AS (SELECT DISTINCT x1 AS gene FROM (SELECT *, row_number() OVER (PARTITION BY x2 ORDER BY p, x1) AS k FROM pm) WHERE k <= 5 OR x1 = x2),
ps AS (SELECT x1, x2, CASE WHEN x1 = x2 THEN 0 ELSE coex END AS coex, c FROM both_ WHERE x2 IN (SELECT gene FROM sec)),
top AS (SELECT x1, coex * coex * c AS v, row_number() OVER (PARTITION BY x1 ORDER BY coex * coex * c DESC) AS k FROM ps),
loc AS (SELECT x1, ln(-ln(avg({tail_sql('v')}))) AS gdi FROM top WHERE k <= greatest(1, round_even((SELECT count(*) FROM sec) * 0.1, 0)) GROUP BY x1),
lim AS (SELECT quantile_cont(gdi, 0.9) AS q FROM loc)
SELECT ps.x1, ps.x2, round(tanh(coex * sqrt(c)), 6) + 0 AS gcs FROM ps JOIN loc USING (x1), lim WHERE gdi >= q"""
)


@query
def genes_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return S.genes_clusters(fitted(spark, sf), {"a": [1, 2], "b": [5, 8]}, 10, 3).select("gene", "cluster", "group")


@query
def cluster_tree(spark: SparkSession, sf: str) -> DataFrame:
    ds = documents_fitted(spark, sf)
    return C.tree_cut(ds, languages(ds, sf), 3)


@query
def reordered_clusters(spark: SparkSession, sf: str) -> DataFrame:
    ds = documents_fitted(spark, sf)
    return C.reorder_clusters(ds, languages(ds, sf))[0].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query
def language_markers(spark: SparkSession, sf: str) -> DataFrame:
    ds = documents_fitted(spark, sf)
    out = C.cluster_markers(ds, languages(ds, sf), 5)
    return out.select("cluster", "gene", r6("dea", 4).alias("dea"), r6("adj_p_value", 4).alias("adj_p_value"), "is_marker", r6("lfc", 4).alias("lfc"))


@query
def language_gdi(spark: SparkSession, sf: str) -> DataFrame:
    return S.gdi(documents_fitted(spark, sf)).select("gene", r6("gdi", 2).alias("gdi"))


@query
def proceed_to_coex(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way from counts to stored COEX."""
    ds = pipelines.proceed_to_coex(dataset(spark, sf), threshold=1e-10)
    return ds.gene_coex.select("x1", "x2", r6("coex", 4).alias("coex"))


#: The default cutoffs leave this matrix whole, and so the SQL says; it returns nothing where they would not.
ORACLES["proceed_to_coex"] = (
    BASE
    + PAIRS
    + """few AS (SELECT (SELECT count(*) FROM gs, dim WHERE n_cells <= round_even(c * 0.003, 0)) + (SELECT count(*) FROM cs, dim WHERE n_genes <= round_even(g * 0.002, 0)) AS k)
SELECT x1, x2, round(coex, 4) + 0 AS coex FROM coex, few WHERE k = 0"""
)


@query
def cluster_uniformity(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of each language on a fresh fit, checked."""
    from tessera.operators.uniformity import SimpleCheck, checks_to_frame

    ds = documents_fitted(spark, sf)
    of = checkpoint(languages(ds, sf))
    names = sorted(r["cluster"] for r in of.select("cluster").distinct().collect() if r["cluster"])
    checks = {c: pipelines.check_uniformity(ds, of.where(F.col("cluster") == c), SimpleCheck()) for c in names}
    return checks_to_frame(spark, checks).select("name", "class", "is_uniform", "cluster_size")


@query
def condition_shares(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.plotdata import condition_shares as shares

    ds = dataset(spark, sf)
    rows = shares(types(ds, sf), brands(ds, sf))
    return rows.unpivot(["cluster"], [c for c in rows.columns if c != "cluster"], "condition", "share").withColumn("share", r6("share"))


ORACLES["condition_shares"] = """
WITH cells AS (SELECT DISTINCT l_partkey AS cell FROM lineitem),
l AS (SELECT p_type AS cluster, p_brand AS condition FROM part JOIN cells ON cell = p_partkey),
n AS (SELECT cluster, condition, count(*) AS n FROM l GROUP BY 1, 2)
SELECT cluster, condition, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY cluster), 6) AS share
FROM (SELECT DISTINCT cluster FROM l) CROSS JOIN (SELECT DISTINCT condition FROM l) LEFT JOIN n USING (cluster, condition)"""


@query
def cells_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.plotdata import cells_heatmap as heatmap

    ds = fitted(spark, sf)
    return heatmap(ds, [1, 2, 3, 5, 8, 13], types(ds, sf)).withColumn("coex", r6("coex"))


ORACLES["cells_heatmap"] = (
    BASE
    + CELL_SQL
    + f"""done AS (SELECT 1)
SELECT x1, x2, round((o_yy - (n - n1 - n2 + nn)) * sqrt((1/greatest(1, nn) + 1/greatest(1, n1 - nn) + 1/greatest(1, n2 - nn) + 1/greatest(1, n - n1 - n2 + nn)) / n), 6) + 0 AS coex,
  a.cluster AS c1, b.cluster AS c2 FROM ct JOIN types a ON a.cell = x1 JOIN types b ON b.cell = x2 WHERE x1 IN {CELL_SET}"""
)


@query
def variable_genes(spark: SparkSession, sf: str) -> DataFrame:
    ds = documents(spark, sf)
    both = S.selected_genes(ds, "HVG_Seurat", 20).select("gene", F.lit("vst").alias("method"))
    return both.unionByName(S.selected_genes(ds, "HVG_Scanpy", 20).select("gene", F.lit("mean.var.plot").alias("method")))


@query
def umap(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids of the languages in two dimensions."""
    import numpy as np

    from tessera.algos.communities import embed
    from tessera.operators.plotdata import centroids

    ds = documents(spark, sf)
    rows = S.reduced_matrix(ds, components=10, genes="HVG_Scanpy", k=200).join(languages(ds, sf), "cell").orderBy("cell").toPandas()
    y = embed(np.array(rows["values"].tolist()), epochs=50)
    points = spark.createDataFrame([(t, float(a), float(b)) for t, (a, b) in zip(rows["cluster"], y, strict=True)], ["type", "x", "y"])
    return centroids(points).select("type", r6("x", 2).alias("x"), r6("y", 2).alias("y"))


@query
def packed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A packed lower triangle of COEX and back."""
    ds = fitted(spark, sf)
    names = ds.genes.select(F.col("gene").alias("name"), "pos")
    pairs = P.coex(ds).join(names.toDF("x1", "j"), "x1").join(names.toDF("x2", "i"), "x2")
    packed = pairs.select(P.pack_position(F.col("i"), F.col("j"), ds.n_genes).alias("position"), F.col("coex").alias("value"))
    return P.unpack(packed, names).select("x1", "x2", r6("value").alias("coex"))


ORACLES["packed_round_trip"] = BASE + PAIRS + "done AS (SELECT 1) SELECT x2 AS x1, x1 AS x2, round(coex, 6) + 0 AS coex FROM coex"


def planted(spark: SparkSession, sf: str) -> tuple[CountDataset, DataFrame]:
    """(a matrix of 40 genes over the suppliers, ``cell, cluster``): two kinds of suppliers that express other genes.

    Counts are drawn by a hash of gene and cell, so every engine and run has the same.
    """
    cells = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("cell"), (F.col("s_suppkey") % 2).alias("kind"))
    drawn = F.pmod(F.xxhash64(F.lit("planted"), "gene", "cell"), F.lit(100))
    rows = cells.withColumn("gene", F.explode(F.sequence(F.lit(0), F.lit(39))))
    own = F.when(F.col("gene") < 10, F.col("kind") == 0).when(F.col("gene") < 20, F.col("kind") == 1).otherwise(F.lit(None))
    n = F.when(own.isNull(), F.floor(drawn / 34)).when(own, 3 + drawn % 3).otherwise(F.lit(0))
    counts = rows.select("gene", "cell", n.cast("long").alias("n"))
    kinds = cells.select("cell", F.concat(F.col("kind").cast("string"), F.lit("_"), (F.floor(F.col("cell") / 2) % 2).cast("string")).alias("cluster"))
    return settled(M.estimate_dispersion(M.estimate_nu(M.estimate_lambda(settled(CountDataset.build(counts)))))), kinds


def _by_least(clusters: DataFrame) -> DataFrame:
    """Clusters named by their smallest cell, for their numbers hang on the tree."""
    real = clusters.where("cluster <> '-1'").groupBy("cluster").agg(F.min("cell").alias("least"))
    return clusters.join(real, "cluster", "left").select("cell", "least")


@query
def uniform_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The two planted kinds, found and checked; communities that split a kind are merged, as far as their unions are uniform."""
    from tessera.operators.uniformity import GDICheck, SimpleCheck

    ds, _ = planted(spark, sf)
    found = pipelines.uniform_clusters(ds, gdi_threshold=2.0, minimum_size=20, reduction={"method": "LN", "components": 5, "genes": "HVG_Scanpy", "k": 30})
    return _by_least(pipelines.merge_uniform_clusters(ds, found[0], [SimpleCheck(GDICheck(gdi_threshold=2.0))])[0])


@query
def merge_uniform_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Halves of the planted kinds, merged where their unions are uniform."""
    from tessera.operators.uniformity import GDICheck, SimpleCheck

    ds, halves = planted(spark, sf)
    checkers = [SimpleCheck(GDICheck(gdi_threshold=t)) for t in (1.5, 2.0)]
    return _by_least(pipelines.merge_uniform_clusters(ds, halves, checkers)[0])


ORACLES["uniform_clusters"] = """
SELECT s_suppkey AS cell, CASE WHEN count(*) OVER () >= 40 THEN min(s_suppkey) OVER (PARTITION BY s_suppkey % 2) END AS least FROM supplier"""
ORACLES["merge_uniform_clusters"] = "SELECT s_suppkey AS cell, min(s_suppkey) OVER (PARTITION BY s_suppkey % 2) AS least FROM supplier"
