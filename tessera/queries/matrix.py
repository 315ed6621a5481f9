"""Queries on the matrix of ``lineitem``: genes are suppliers, cells are parts, counts are rows.

Clusters are the parts' types, conditions their brands. Each query has its SQL beside it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.dataset import CountDataset, checkpoint, settled
from tessera.operators import clusters as C
from tessera.operators import labels as L
from tessera.operators import model as M
from tessera.operators import pairs as P
from tessera.operators import plotdata as V
from tessera.operators import raw as R
from tessera.operators import scores as S
from tessera.operators import uniformity as U

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TIGHT = 1e-10
#: Genes and cells that partial queries ask for, by position in the order of names.
GENES, CELLS = [1, 2, 3, 5, 8], [1, 2, 3, 5, 8, 13]


def r6(x, digits: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, digits) + F.lit(0.0)


def counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rows.groupBy(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def dataset(spark: SparkSession, sf: str) -> CountDataset:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")  # names from the rows: those of the counts would be shuffled with them
    names = (rows.select(F.col(c).alias(k)).distinct() for c, k in (("l_suppkey", "gene"), ("l_partkey", "cell")))
    return CountDataset.build(counts(spark, sf), *names, check=False)


def linear(spark: SparkSession, sf: str) -> CountDataset:
    return M.estimate_nu(M.estimate_lambda(dataset(spark, sf)))


def fitted(spark: SparkSession, sf: str) -> CountDataset:
    """The counts and the names are written out once: a fit reads them again and again."""
    ds = dataset(spark, sf)
    ds = M.estimate_nu(M.estimate_lambda(settled(ds)))
    return M.estimate_dispersion(replace(ds, cells=checkpoint(ds.cells)), TIGHT)


def part_labels(ds: CountDataset, sf: str, column: str, name: str) -> DataFrame:
    part = ds.spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("cell"), F.col(column).alias(name))
    return ds.cells.select("cell").join(part, "cell")


def types(ds: CountDataset, sf: str) -> DataFrame:
    return part_labels(ds, sf, "p_type", "cluster")


def brands(ds: CountDataset, sf: str) -> DataFrame:
    return part_labels(ds, sf, "p_brand", "condition")


BASE = """
WITH RECURSIVE
counts AS (SELECT l_suppkey AS gene, l_partkey AS cell, count(*) AS n FROM lineitem GROUP BY 1, 2),
dim AS (SELECT count(DISTINCT gene) AS g, count(DISTINCT cell) AS c FROM counts),
cs AS (SELECT cell, sum(n)::BIGINT AS size, count(*) AS n_genes FROM counts GROUP BY cell),
gs AS (SELECT gene, sum(n)::BIGINT AS size, count(*) AS n_cells FROM counts GROUP BY gene),
cells AS (SELECT cell, size, n_genes, size / (SELECT avg(size) FROM cs) AS nu FROM cs),
hist AS (SELECT nu, count(*) AS m FROM cells GROUP BY nu),
types AS (SELECT p_partkey AS cell, p_type AS cluster FROM part JOIN cs ON cell = p_partkey),
brands AS (SELECT p_partkey AS cell, p_brand AS condition FROM part JOIN cs ON cell = p_partkey),
init AS (SELECT gene, size::DOUBLE / c AS lam, c - n_cells AS zeros FROM gs, dim),
side AS (SELECT gene, lam, zeros, sum(m * exp(-lam * nu)) >= zeros AS neg FROM init, hist GROUP BY gene, lam, zeros),
solve(gene, lam, zeros, low, high, i) AS (
  SELECT gene, lam, zeros, CASE WHEN neg THEN -256.0 ELSE 0.0 END::DOUBLE, CASE WHEN neg THEN 0.0 ELSE 1024.0 END::DOUBLE, 0 FROM side WHERE zeros > 0
  UNION ALL
  SELECT gene, lam, zeros, CASE WHEN p < zeros THEN mid ELSE low END, CASE WHEN p < zeros THEN high ELSE mid END, i + 1
  FROM (
    SELECT gene, lam, zeros, low, high, i, (low + high) / 2 AS mid,
      sum(m * CASE WHEN low + high < 2e-5 THEN exp(((low + high) / 2 - 1) * lam * nu) ELSE exp(-ln(1 + (low + high) / 2 * lam * nu) / ((low + high) / 2)) END) AS p
    FROM solve, hist WHERE i < 75 GROUP BY gene, lam, zeros, low, high, i)),
genes AS (
  SELECT gene, lam, (low + high) / 2 AS dispersion FROM solve WHERE i = 75
  UNION ALL SELECT gene, lam, '-inf'::DOUBLE FROM init WHERE zeros = 0),
"""


def p0_sql(a: str, mu: str) -> str:
    return f"CASE WHEN {a} = '-inf'::DOUBLE THEN 0 WHEN {a} < 1e-5 THEN exp(({a} - 1) * {mu}) ELSE exp(-ln(1 + {a} * {mu}) / {a}) END"


def tail_sql(s: str) -> str:
    """The chi-square tail, as ``chi_square_tail``."""
    return f"""(SELECT CASE WHEN x <= 0 THEN 1.0 WHEN x < 2 THEN
      1 - list_sum([exp(-x*x + (2*k+1)*ln(x) - lgamma(k+1.5)) FOR k IN range(0, 60)])
      ELSE exp(-x*x) / sqrt(pi()) / list_reduce(list_prepend(x, [k/2.0::DOUBLE FOR k IN range(120, 0, -1)]), lambda acc, h: x + h/acc) END
      FROM (SELECT sqrt(greatest({s}, 0)/2) AS x))"""


PZ = f"pz AS (SELECT gene, nu, m, {p0_sql('dispersion', 'lam * nu')} AS p0 FROM genes, hist),\n"
PAIRS = (
    PZ
    + """nn AS (SELECT a.gene AS x1, b.gene AS x2, sum(a.m * a.p0 * b.p0) AS nn, sum(a.m * a.p0) AS n1, sum(a.m * b.p0) AS n2
  FROM pz a JOIN pz b ON a.nu = b.nu WHERE a.gene <= b.gene GROUP BY 1, 2),
yy AS (SELECT a.gene AS x1, b.gene AS x2, count(*) AS yy FROM counts a JOIN counts b USING (cell) WHERE a.gene <= b.gene GROUP BY 1, 2),
tables AS (
  SELECT x1, x2, c, nn AS e_nn, n1 - nn AS e_ny, n2 - nn AS e_yn, c - n1 - n2 + nn AS e_yy,
    coalesce(yy, 0) AS o_yy, g1.n_cells - coalesce(yy, 0) AS o_yn, g2.n_cells - coalesce(yy, 0) AS o_ny,
    c - g1.n_cells - g2.n_cells + coalesce(yy, 0) AS o_nn
  FROM nn LEFT JOIN yy USING (x1, x2) JOIN gs g1 ON g1.gene = x1 JOIN gs g2 ON g2.gene = x2, dim),
coex AS (
  SELECT x1, x2, c, (o_yy - e_yy) * sqrt((1/greatest(1, e_nn) + 1/greatest(1, e_ny) + 1/greatest(1, e_yn) + 1/greatest(1, e_yy)) / c) AS coex FROM tables),
both_ AS (SELECT x1, x2, c, coex FROM coex UNION ALL SELECT x2, x1, c, coex FROM coex WHERE x1 <> x2),
s AS (SELECT x1, x2, CASE WHEN x1 = x2 THEN 0 ELSE coex * coex * c END AS s FROM both_),
"""
)


def gdi_sql(s: str = "s") -> str:
    return f"""top AS (SELECT x2, s, row_number() OVER (PARTITION BY x2 ORDER BY s DESC) AS r FROM {s}),
gdi AS (SELECT x2 AS gene, ln(-ln(avg({tail_sql('s')}))) AS gdi FROM top, dim WHERE r <= greatest(1, round_even(g * 0.05, 0)) GROUP BY x2),
nun AS (SELECT gene, log10(sum(n * (1 / nu))) AS sum_raw_norm FROM counts JOIN cells USING (cell) GROUP BY gene),
"""


DEA = (
    PZ.replace("pz AS", "pz0 AS")
    + f"""ch AS (SELECT cluster, nu, count(*) AS m FROM cells JOIN types USING (cell) GROUP BY 1, 2),
ins AS (SELECT cluster, count(*) AS n_in FROM types GROUP BY 1),
ni AS (SELECT gene, cluster, sum(m * ({p0_sql('dispersion', 'lam * nu')})) AS ni FROM genes, ch GROUP BY 1, 2),
oyi AS (SELECT gene, cluster, count(*) AS o_yi FROM counts JOIN types USING (cell) GROUP BY 1, 2),
dt AS (SELECT gene, cluster, n_in, ni, no, n_in - ni AS yi, c - n_in - no AS yo, coalesce(o_yi, 0) AS o_yi, c, g
  FROM (SELECT *, sum(ni) OVER (PARTITION BY gene) - ni AS no FROM ni) JOIN ins USING (cluster) LEFT JOIN oyi USING (gene, cluster), dim),
dea AS (SELECT gene, cluster, c, g, (o_yi - yi) / sqrt(c) * sqrt(1/greatest(1, ni) + 1/greatest(1, no) + 1/greatest(1, yi) + 1/greatest(1, yo)) AS coex FROM dt),
dp AS (SELECT gene, cluster, g, {tail_sql('coex * coex * c')} AS p FROM dea),
sums AS (SELECT gene, cluster, sum(n * (1 / nu)) AS s FROM counts JOIN cells USING (cell) JOIN types USING (cell) GROUP BY 1, 2),
lg AS (SELECT gene, cluster, lam, n_in, c, coalesce(s, 0) AS s, sum(coalesce(s, 0)) OVER (PARTITION BY gene) AS t
  FROM genes CROSS JOIN ins LEFT JOIN sums USING (gene, cluster), dim),
lfc AS (SELECT gene, cluster, log10(greatest(s / greatest(n_in, 1), 0.05 * lam)) - log10(greatest((t - s) / greatest(c - n_in, 1), 0.05 * lam)) AS lfc FROM lg),
"""
)


def query(name: str, sql: str | None = None, parts: str = ""):
    """Registers a query and its SQL after the common tables."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = BASE + parts + "done AS (SELECT 1) " + sql
        return f

    return add


# sizes, rates, projections


@query("gene_sizes", "SELECT gene, size, n_cells FROM gs")
def gene_sizes(spark, sf):
    ds = dataset(spark, sf)
    return R.gene_sizes(ds).join(R.expressing_cells(ds), ["gene", "pos"]).select("gene", "size", "n_cells")


@query("cell_sizes", "SELECT cell, size, n_genes FROM cs")
def cell_sizes(spark, sf):
    ds = dataset(spark, sf)
    return R.cell_sizes(ds).join(R.expressed_genes(ds), ["cell", "pos"]).select("cell", "size", "n_genes")


@query("gene_lambda", "SELECT gene, round(lam, 6) AS rate FROM init")
def gene_lambda(spark, sf):
    return linear(spark, sf).genes.select("gene", r6("lambda").alias("rate"))


@query("cell_nu", "SELECT cell, round(nu, 6) AS nu FROM cells")
def cell_nu(spark, sf):
    return linear(spark, sf).cells.select("cell", r6("nu").alias("nu"))


@query("poisson_zeros", "SELECT gene, zeros, round(sum(m * exp(-lam * nu)), 4) AS expected FROM init, hist GROUP BY gene, zeros")
def poisson_zeros(spark, sf):
    ds = linear(spark, sf)
    even = ds.with_gene_columns(ds.genes.select("gene", F.lit(0.0).alias("dispersion")))
    zeros = R.expressing_cells(ds).select("gene", (F.lit(ds.n_cells) - F.col("n_cells")).alias("zeros"))
    return M.expected_zeros(even).join(zeros.withColumnRenamed("zeros", "seen"), "gene").select("gene", F.col("seen").alias("zeros"), r6("zeros", 4).alias("expected"))


@query("nu_by_cluster", "SELECT cell, round(size / avg(size) OVER (PARTITION BY cluster), 6) AS nu FROM cs JOIN types USING (cell)")
def nu_by_cluster(spark, sf):
    ds = dataset(spark, sf)
    return M.nu_by_cluster(ds, types(ds, sf)).cells.select("cell", r6("nu").alias("nu"))


@query("nu_norm", "SELECT gene, cell, round(n * (1 / nu), 6) AS value FROM counts JOIN cells USING (cell)")
def nu_norm(spark, sf):
    return R.nu_normalised(linear(spark, sf)).select("gene", "cell", r6("value").alias("value"))


@query("log_norm", "SELECT gene, cell, round(ln(1 + n * 1e4 / size) / ln(10), 6) AS value FROM counts JOIN cs USING (cell)")
def log_norm(spark, sf):
    return R.log_normalised(dataset(spark, sf)).select("gene", "cell", r6("value").alias("value"))


@query("zero_one", "SELECT gene, cell, 1 AS z FROM counts")
def zero_one(spark, sf):
    return R.zero_one(dataset(spark, sf))


# cleaning

CLEAN = """q AS (SELECT (SELECT quantile_disc(n_cells, 0.25) FROM gs) / c::DOUBLE AS few_cells, (SELECT quantile_disc(n_genes, 0.25) FROM cs) / g::DOUBLE AS few_genes FROM dim),
g1 AS (SELECT gene FROM gs, dim, q WHERE n_cells > round_even(c * few_cells, 0)),
k1 AS (SELECT counts.* FROM counts JOIN g1 USING (gene)),
c1 AS (SELECT cell, count(*) AS k FROM k1 GROUP BY cell HAVING count(*) > round_even((SELECT count(*) FROM g1) * (SELECT few_genes FROM q), 0)),
k2 AS (SELECT k1.* FROM k1 JOIN c1 USING (cell)),
"""


def cleaned(spark: SparkSession, sf: str) -> CountDataset:
    """Cut at the lower quartiles of the matrix, so that it makes sense at any size."""
    ds = dataset(spark, sf)
    quartile = lambda df, c: df.agg(F.expr(f"percentile_disc(0.25) WITHIN GROUP (ORDER BY {c})").alias("q")).first()["q"]
    return R.clean(ds, quartile(R.expressing_cells(ds), "n_cells") / ds.n_cells, quartile(R.expressed_genes(ds), "n_genes") / ds.n_genes)


@query("clean_genes_cells", "SELECT gene, count(*) AS n_cells, sum(n)::BIGINT AS size FROM k2 GROUP BY gene", CLEAN)
def clean_genes_cells(spark, sf):
    ds = cleaned(spark, sf)
    return R.expressing_cells(ds).join(R.gene_sizes(ds), ["gene", "pos"]).select("gene", "n_cells", "size")


@query("clean_nu", "SELECT cell, round(sum(n) / (SELECT avg(s) FROM (SELECT sum(n) AS s FROM k2 GROUP BY cell)), 6) AS nu FROM k2 GROUP BY cell", CLEAN)
def clean_nu(spark, sf):
    return cleaned(spark, sf).cells.select("cell", r6("nu").alias("nu"))


@query("fully_expressed_genes", "SELECT gene, n_cells >= 0.26 * c AS fe_genes FROM gs, dim")
def fully_expressed_genes(spark, sf):
    return R.flag_fully_expressed(dataset(spark, sf), 0.26, 0.3).genes.select("gene", "fe_genes")


@query("fully_expressing_cells", "SELECT cell, n_genes >= 0.3 * g AS fe_cells FROM cs, dim")
def fully_expressing_cells(spark, sf):
    return R.flag_fully_expressed(dataset(spark, sf), 0.26, 0.3).cells.select("cell", "fe_cells")


@query("drop_genes_cells", "SELECT gene, cell, n FROM counts WHERE gene % 7 <> 0 AND cell % 5 <> 0")
def drop_genes_cells(spark, sf):
    ds = dataset(spark, sf)
    return R.drop_genes_cells(ds, ds.genes.where("gene % 7 = 0"), ds.cells.where("cell % 5 = 0")).counts


# model


@query("dispersion", "SELECT gene, round(dispersion, 6) + 0 AS dispersion FROM genes")
def dispersion(spark, sf):
    return fitted(spark, sf).genes.select("gene", r6("dispersion").alias("dispersion"))


@query("expected_zeros", "SELECT gene, round(sum(m * p0), 4) AS zeros FROM pz GROUP BY gene", PZ)
def expected_zeros(spark, sf):
    return M.expected_zeros(fitted(spark, sf)).select("gene", r6("zeros", 4).alias("zeros"))


@query("genes_ce", f"SELECT gene, round(-sum(CASE WHEN n IS NULL THEN ln(p0) ELSE ln(1 - p0) END) / any_value(c), 6) + 0 AS ce FROM (SELECT gene, cell, {p0_sql('dispersion', 'lam * nu')} AS p0 FROM genes, cells) LEFT JOIN counts USING (gene, cell), dim GROUP BY gene")
def genes_ce(spark, sf):
    return S.cross_entropy(fitted(spark, sf)).select("gene", r6("ce").alias("ce"))


DENSE = f"dn AS (SELECT gene, cell, coalesce(n, 0) AS n, {p0_sql('dispersion', 'lam * nu')} AS p0, size, nu FROM genes CROSS JOIN cells LEFT JOIN counts USING (gene, cell)),\nlk AS (SELECT *, greatest(least(p0, 1 - 1e-8), 1e-8) AS p FROM dn),\n"
LIKELIHOOD = {
    "raw": "CASE WHEN n > 0 THEN 1 - p ELSE p END",
    "log": "CASE WHEN n > 0 THEN ln(1 - p) ELSE ln(p) END",
    "der": "CASE WHEN n > 0 THEN -1 / (1 - p) ELSE 1 / p END",
    "sLog": "CASE WHEN n > 0 THEN -ln(1 - p) ELSE ln(p) END",
}
for _name, _sql in LIKELIHOOD.items():

    def _likelihood(spark, sf, name=_name):
        return R.likelihood(fitted(spark, sf), name, 5)

    query(f"likelihood_{_name.lower()}", f"SELECT gene, cell, round({_sql}, 5) + 0 AS value FROM lk", DENSE)(_likelihood)

MATRICES = {
    "raw": ("RawData", "n::DOUBLE", True), "nu": ("NuNorm", "n * (1 / nu)", True), "log": ("LN", "ln(1 + n * 1e4 / size) / ln(10)", True), "binary": ("Bin", "1.0::DOUBLE", True),
    "discrepancy": ("BD", "CASE WHEN n > 0 THEN p0 ELSE p0 - 1 END", False), "adjusted": ("AdjBin", "CASE WHEN n > 0 THEN p0 ELSE 1 - p0 END", False),
}
for _name, (_method, _sql, _sparse) in MATRICES.items():

    def _matrix(spark, sf, method=_method):
        return R.data_matrix(fitted(spark, sf), method, 5)

    query(f"data_matrix_{_name}", f"SELECT gene, cell, round({_sql}, 5) + 0 AS value FROM lk" + " WHERE n > 0" * _sparse, DENSE)(_matrix)


# pairs


@query("observed_yy", "SELECT x1, x2, yy FROM yy", PAIRS)
def observed_yy(spark, sf):
    return P.observed_yy(dataset(spark, sf))


@query("observed_tables", "SELECT x1, x2, o_nn AS nn, o_ny AS ny, o_yn AS yn, o_yy AS yy FROM tables", PAIRS)
def observed_tables(spark, sf):
    return P.observed_tables(dataset(spark, sf))


@query("expected_tables", "SELECT x1, x2, round(e_nn, 4) AS nn, round(e_ny, 4) AS ny, round(e_yn, 4) AS yn, round(e_yy, 4) AS yy FROM tables", PAIRS)
def expected_tables(spark, sf):
    return P.expected_tables(fitted(spark, sf)).select("x1", "x2", *[r6(c, 4).alias(c) for c in P.CELLS_OF_TABLE])


@query("coex", "SELECT x1, x2, round(coex, 6) + 0 AS coex FROM coex", PAIRS)
def coex(spark, sf):
    return P.coex(fitted(spark, sf)).select("x1", "x2", r6("coex").alias("coex"))


@query("coex_top_pairs", "SELECT x1, x2, round(coex, 6) + 0 AS coex FROM coex WHERE x1 <> x2 ORDER BY round(coex, 6) DESC, x1, x2 LIMIT 50", PAIRS)
def coex_top_pairs(spark, sf):
    rows = P.coex(fitted(spark, sf)).where("x1 <> x2").select("x1", "x2", r6("coex").alias("coex"))
    return rows.orderBy(F.desc("coex"), "x1", "x2").limit(50)


@query("small_expected_fraction", "SELECT round(avg((least(e_nn, e_ny, e_yn, e_yy) < 0.5)::INT), 6) AS fraction FROM tables", PAIRS)
def small_expected_fraction(spark, sf):
    return P.small_expected_fraction(fitted(spark, sf)).select(r6("fraction").alias("fraction"))


SUBSET = f"({', '.join(map(str, GENES))})"


@query("partial_coex", f"SELECT x1, x2, round(coex, 6) + 0 AS coex FROM both_ WHERE x2 IN {SUBSET}", PAIRS)
def partial_coex(spark, sf):
    return P.coex(fitted(spark, sf), subset=GENES).select("x1", "x2", r6("coex").alias("coex"))


@query(
    "contingency_pair",
    "SELECT x1, x2, round(e_nn, 4) AS e_nn, round(e_ny, 4) AS e_ny, round(e_yn, 4) AS e_yn, round(e_yy, 4) AS e_yy, o_nn, o_ny, o_yn, o_yy FROM tables WHERE x1 = 2 AND x2 = 5",
    PAIRS,
)
def contingency_pair(spark, sf):
    row = P.contingency_pair(fitted(spark, sf), 2, 5)
    return row.select("x1", "x2", *[r6(f"e_{c}", 4).alias(f"e_{c}") for c in P.CELLS_OF_TABLE], *[f"o_{c}" for c in P.CELLS_OF_TABLE])


@query("s_stat", "SELECT x1, x2, round(s, 5) + 0 AS s FROM s", PAIRS)
def s_stat(spark, sf):
    return P.s_statistic(fitted(spark, sf)).select("x1", "x2", r6("s", 5).alias("s"))


G_TERMS = " + ".join(f"CASE WHEN o_{c} = 0 THEN 0 ELSE o_{c} * ln(o_{c} / greatest(1, e_{c})) END" for c in P.CELLS_OF_TABLE)
G_SQL = f"g_ AS (SELECT x1, x2, CASE WHEN x1 = x2 THEN 0 ELSE 2 * ({G_TERMS}) END AS s FROM tables),\ngs_ AS (SELECT * FROM g_ UNION ALL SELECT x2, x1, s FROM g_ WHERE x1 <> x2),\n"


@query("g_stat", "SELECT x1, x2, round(s, 5) + 0 AS s FROM gs_", PAIRS + G_SQL)
def g_stat(spark, sf):
    return P.g_statistic(fitted(spark, sf)).select("x1", "x2", r6("s", 5).alias("s"))


@query("p_value", f"SELECT x1, x2, round({tail_sql('s')}, 6) AS p_value FROM s", PAIRS)
def p_value(spark, sf):
    return P.p_values(fitted(spark, sf)).select("x1", "x2", r6("p_value").alias("p_value"))


@query("p_value_g", f"SELECT x1, x2, round({tail_sql('s')}, 6) AS p_value FROM gs_", PAIRS + G_SQL)
def p_value_g(spark, sf):
    return P.p_values(fitted(spark, sf), "G").select("x1", "x2", r6("p_value").alias("p_value"))


@query("pdi", f"SELECT x1, x2, round(ln(-ln({tail_sql('s')})), 4) AS pdi FROM s WHERE x1 <> x2 AND s > 0.01", PAIRS)
def pdi(spark, sf):
    return P.pdi(fitted(spark, sf), above=0.01).select("x1", "x2", r6("pdi", 4).alias("pdi"))


CELL_SET = f"({', '.join(map(str, CELLS))})"
CELL_SQL = f"""cp AS (SELECT cell, gene, {p0_sql('dispersion', 'lam * nu')} AS p0, (n IS NOT NULL)::INT AS z FROM genes CROSS JOIN cells LEFT JOIN counts USING (gene, cell)),
ct AS (SELECT a.cell AS x1, b.cell AS x2, sum(a.p0 * b.p0) AS nn, sum(a.p0) AS n1, sum(b.p0) AS n2, sum(a.z * b.z) AS o_yy, count(*) AS n
  FROM cp a JOIN cp b USING (gene) WHERE b.cell IN {CELL_SET} GROUP BY 1, 2),
"""


@query(
    "cell_coex",
    "SELECT x1, x2, round((o_yy - (n - n1 - n2 + nn)) * sqrt((1/greatest(1, nn) + 1/greatest(1, n1 - nn) + 1/greatest(1, n2 - nn) + 1/greatest(1, n - n1 - n2 + nn)) / n), 6) + 0 AS coex FROM ct",
    CELL_SQL,
)
def cell_coex(spark, sf):
    return P.coex(fitted(spark, sf), cells=True, subset=CELLS).select("x1", "x2", r6("coex").alias("coex"))


# scores


@query(
    "gdi",
    "SELECT gdi.gene, round(sum_raw_norm, 6) AS sum_raw_norm, round(gdi, 4) AS gdi, round(100.0::DOUBLE * n_cells / c, 6) AS exp_cells FROM gdi JOIN nun USING (gene) JOIN gs USING (gene), dim",
    PAIRS + gdi_sql(),
)
def gdi(spark, sf):
    return S.gdi(fitted(spark, sf)).select("gene", r6("sum_raw_norm").alias("sum_raw_norm"), r6("gdi", 4).alias("gdi"), r6("exp_cells").alias("exp_cells"))


@query("gdi_g", "SELECT gene, round(gdi, 4) AS gdi FROM gdi", PAIRS + G_SQL + gdi_sql("gs_"))
def gdi_g(spark, sf):
    return S.gdi(fitted(spark, sf), "G").select("gene", r6("gdi", 4).alias("gdi"))


@query("selected_genes", "SELECT gene FROM gdi ORDER BY round(gdi, 9) DESC, gene LIMIT 20", PAIRS + gdi_sql())
def selected_genes(spark, sf):
    return S.selected_genes(fitted(spark, sf), "HGDI", 20).select("gene")


CORR = f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS k FROM embeddings),
m AS (SELECT k, avg(v) AS mu, stddev_pop(v) AS sd FROM e GROUP BY k),
c AS (SELECT a.k AS x1, b.k AS x2, (avg(a.v * b.v) - any_value(ma.mu) * any_value(mb.mu)) / (any_value(ma.sd) * any_value(mb.sd)) AS corr
  FROM e a JOIN e b USING (vec_id) JOIN m ma ON ma.k = a.k JOIN m mb ON mb.k = b.k GROUP BY 1, 2),
s AS (SELECT x1, x2, CASE WHEN x1 = x2 THEN 0 ELSE corr * corr * (SELECT count(DISTINCT vec_id) FROM e) END AS s FROM c),
t AS (SELECT x2, s, row_number() OVER (PARTITION BY x2 ORDER BY s DESC) AS r FROM s)
SELECT x2, round(ln(-ln(avg({tail_sql('s')}))), 4) AS gdi FROM t WHERE r <= 3 GROUP BY x2"""


def gdi_given_correlation(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    each = rows.groupBy("k").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    a, b = (rows.select("vec_id", F.col("k").alias(f"x{i}"), F.col("v").alias(f"v{i}")) for i in (1, 2))
    product = a.join(b, "vec_id").groupBy("x1", "x2").agg(F.avg(F.col("v1") * F.col("v2")).alias("p"))
    m1, m2 = (F.broadcast(each.toDF(f"x{i}", f"mu{i}", f"sd{i}")) for i in (1, 2))
    corr = product.join(m1, "x1").join(m2, "x2").select("x1", "x2", F.when(F.col("x1") == F.col("x2"), 0.0).otherwise((F.col("p") - F.col("mu1") * F.col("mu2")) / (F.col("sd1") * F.col("sd2"))).alias("corr"))
    return S.gdi_given_correlation(corr, n, 64).select("x2", r6("gdi", 4).alias("gdi"))


QUERIES["gdi_given_correlation"], ORACLES["gdi_given_correlation"] = gdi_given_correlation, CORR


# clusters


@query("dea", "SELECT gene, cluster, round(coex, 6) + 0 AS coex FROM dea", DEA)
def dea(spark, sf):
    ds = fitted(spark, sf)
    return C.dea(ds, types(ds, sf)).select("gene", "cluster", r6("coex").alias("coex"))


ADJUSTED = {
    "none": "p", "bonferroni": "least(1, p * g)", "holm": "least(1, max((g - i + 1) * p) OVER up)", "hochberg": "least(1, min((g - i + 1) * p) OVER down)",
    "bh": "least(1, min(g::DOUBLE / i * p) OVER down)", "by": "least(1, min(g * (SELECT sum(1.0::DOUBLE / k) FROM range(1, (SELECT g FROM dim) + 1) t(k)) / i * p) OVER down)",
}
for _name, _sql in ADJUSTED.items():

    def _adjusted(spark, sf, method=_name):
        ds = fitted(spark, sf)
        out = C.dea_p_values(C.dea(ds, types(ds, sf)), ds.n_cells, ds.n_genes, method.upper() if method in ("bh", "by") else method)
        return out.select("gene", "cluster", r6("p_value").alias("p_value"))

    query(
        f"dea_p_{_name}",
        f"SELECT gene, cluster, round({_sql}, 6) AS p_value FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p, gene) AS i FROM dp) "
        "WINDOW up AS (PARTITION BY cluster ORDER BY i ROWS UNBOUNDED PRECEDING), down AS (PARTITION BY cluster ORDER BY i DESC ROWS UNBOUNDED PRECEDING)",
        DEA,
    )(_adjusted)


HOMMEL = """hr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p, gene) AS i, count(*) OVER (PARTITION BY cluster) AS k FROM dp),
hs AS (SELECT a.cluster, a.i AS m, min(a.i * b.p / (b.i - (b.k - a.i))) AS s FROM hr a JOIN hr b ON a.cluster = b.cluster AND b.i > b.k - a.i GROUP BY 1, 2),
ht AS (SELECT cluster, m, max(s) OVER (PARTITION BY cluster ORDER BY m DESC) AS t FROM hs),
hm AS (SELECT hr.cluster, gene, any_value(p) AS p, count(*) FILTER (t > m * p) AS most FROM hr JOIN ht USING (cluster) GROUP BY 1, 2),
"""


@query(
    "dea_p_hommel",
    """SELECT gene, hm.cluster, round(least(1, CASE WHEN most = 0 THEN first.t ELSE greatest(coalesce(next.t, 0), most * p) END), 6) AS p_value
    FROM hm LEFT JOIN ht next ON next.cluster = hm.cluster AND next.m = most + 1 JOIN ht first ON first.cluster = hm.cluster AND first.m = 1""",
    DEA + HOMMEL,
)
def dea_p_hommel(spark, sf):
    ds = fitted(spark, sf)
    return C.dea_p_values(C.dea(ds, types(ds, sf)), ds.n_cells, ds.n_genes, "hommel").select("gene", "cluster", r6("p_value").alias("p_value"))


@query("cluster_gene_table", "SELECT gene, n_in, round(ni, 4) AS ni, round(no, 4) AS no, round(yi, 4) AS yi, round(yo, 4) AS yo, o_yi FROM dt WHERE gene = 3 AND cluster = (SELECT min(cluster) FROM types)", DEA)
def cluster_gene_table(spark, sf):
    ds = fitted(spark, sf)
    first = types(ds, sf)
    cells = first.join(F.broadcast(first.agg(F.min("cluster").alias("cluster"))), "cluster")
    return C.cluster_gene_table(ds, 3, cells).select("gene", "n_in", *[r6(c, 4).alias(c) for c in ("ni", "no", "yi", "yo")], "o_yi")


@query("log_fold_change", "SELECT gene, cluster, round(lfc, 6) + 0 AS lfc FROM lfc", DEA)
def log_fold_change(spark, sf):
    ds = linear(spark, sf)
    return C.log_fold_change(ds, types(ds, sf)).select("gene", "cluster", r6("lfc").alias("lfc"))


@query("delta_expression", "SELECT gene, cluster, round((o_yi - yi) / t, 6) + 0 AS delta FROM dt JOIN (SELECT cluster, sum(nu) AS t FROM cells JOIN types USING (cell) GROUP BY 1) USING (cluster)", DEA)
def delta_expression(spark, sf):
    ds = fitted(spark, sf)
    return C.delta_expression(ds, types(ds, sf)).select("gene", "cluster", r6("delta").alias("delta"))


@query(
    "cluster_distance_cosine",
    "SELECT a.cluster AS c1, b.cluster AS c2, round(1 - sum(a.coex * b.coex) / (sqrt(sum(a.coex * a.coex)) * sqrt(sum(b.coex * b.coex))), 6) AS distance FROM dea a JOIN dea b USING (gene) WHERE a.cluster < b.cluster GROUP BY 1, 2",
    DEA,
)
def cluster_distance_cosine(spark, sf):
    ds = fitted(spark, sf)
    return C.cluster_distances(ds, types(ds, sf)).select("c1", "c2", r6("distance").alias("distance"))


@query(
    "cluster_distance_euclidean",
    "SELECT a.cluster AS c1, b.cluster AS c2, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS distance FROM zo a JOIN zo b USING (gene) WHERE a.cluster < b.cluster GROUP BY 1, 2",
    DEA + "zo AS (SELECT gene, cluster, CASE WHEN o_yi = 0 THEN 1e-6 ELSE o_yi / n_in END AS v FROM dt),\n",
)
def cluster_distance_euclidean(spark, sf):
    ds = dataset(spark, sf)
    return C.cluster_distances(ds, types(ds, sf), use_dea=False).select("c1", "c2", r6("distance").alias("distance"))


@query(
    "cluster_markers",
    f"SELECT cluster, gene, round(coex, 6) + 0 AS dea, round(least(1, p * g), 6) AS adj_p_value, (gene IN {SUBSET})::INT AS is_marker, round(lfc, 6) + 0 AS lfc FROM (SELECT * FROM rk WHERE low <= 5 UNION ALL SELECT * FROM rk WHERE high <= 5)",
    DEA
    + "rk AS (SELECT dea.gene, dea.cluster, dea.g, coex, p, lfc, row_number() OVER (PARTITION BY cluster ORDER BY coex, gene) AS low, row_number() OVER (PARTITION BY cluster ORDER BY coex DESC, gene) AS high FROM dea JOIN dp USING (gene, cluster) JOIN lfc USING (gene, cluster)),\n",
)
def cluster_markers(spark, sf):
    ds = fitted(spark, sf)
    out = C.cluster_markers(ds, types(ds, sf), 5, GENES)
    return out.select("cluster", "gene", r6("dea").alias("dea"), r6("adj_p_value").alias("adj_p_value"), "is_marker", r6("lfc").alias("lfc"))


GROUPS = {"low": [1, 2, 3, 4], "high": [6, 7, 8, 9, 10], "odd": [5, 10**9]}
GROUP_SQL = "grp AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {g}::BIGINT)" for k, v in GROUPS.items() for g in v) + ') t("group", gene)),\n'


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, g) for k, v in GROUPS.items() for g in v], "group string, gene long")


@query(
    "enrichment",
    'SELECT "group", cluster, round(sum(1 - exp(10 * ln(0.25) * greatest(coex, 0))) / any_value(n_total), 6) AS score, count(*) AS n_detected, any_value(n_total) AS n_total FROM grp JOIN dea USING (gene) JOIN (SELECT "group", count(*) AS n_total FROM grp GROUP BY 1) USING ("group") GROUP BY 1, 2',
    DEA + GROUP_SQL,
)
def enrichment(spark, sf):
    ds = fitted(spark, sf)
    out = C.enrichment(C.dea(ds, types(ds, sf)), groups(spark))
    return out.select("group", "cluster", r6("score").alias("score"), "n_detected", "n_total")


SUMMARY = """cc AS (SELECT cluster, condition, count(*) AS cell_number, avg(nu) AS mean_ude, median(nu) AS median_ude FROM types JOIN brands USING (cell) JOIN cells USING (cell) GROUP BY 1, 2),
ck AS (SELECT cluster, condition, gene, count(*) AS k FROM counts JOIN types USING (cell) JOIN brands USING (cell) GROUP BY 1, 2, 3),
cg AS (SELECT cluster, condition, count(*) FILTER (k > cell_number * 0.25) AS e25, count(*) AS e FROM ck JOIN cc USING (cluster, condition) GROUP BY 1, 2),
su AS (SELECT cluster, condition, coalesce(cell_number, 0) AS cell_number, 100.0::DOUBLE * coalesce(cell_number, 0) / c AS cell_percentage, mean_ude, median_ude, coalesce(e25, 0) AS exp_genes_25, coalesce(e, 0) AS exp_genes
  FROM (SELECT DISTINCT cluster FROM types) CROSS JOIN (SELECT DISTINCT condition FROM brands) LEFT JOIN cc USING (cluster, condition) LEFT JOIN cg USING (cluster, condition), dim),
"""


@query("cluster_summary", "SELECT cluster, condition, cell_number, round(cell_percentage, 6) AS cell_percentage, round(mean_ude, 6) AS mean_ude, round(median_ude, 6) AS median_ude, exp_genes_25, exp_genes FROM su", SUMMARY)
def cluster_summary(spark, sf):
    ds = linear(spark, sf)
    out = C.cluster_summary(ds, types(ds, sf), brands(ds, sf))
    return out.select("cluster", "condition", "cell_number", *[r6(c).alias(c) for c in ("cell_percentage", "mean_ude", "median_ude")], "exp_genes_25", "exp_genes")


# labels


@query("merge_clusters", "SELECT cell, CASE WHEN cluster IN (SELECT cluster FROM (SELECT DISTINCT cluster FROM types ORDER BY 1 LIMIT 2)) THEN (SELECT string_agg(cluster, '_' ORDER BY cluster) FROM (SELECT DISTINCT cluster FROM types ORDER BY 1 LIMIT 2)) || '-merge' ELSE cluster END AS cluster FROM types")
def merge_clusters(spark, sf):
    ds = dataset(spark, sf)
    rows = types(ds, sf)
    first = [r["cluster"] for r in rows.select("cluster").distinct().orderBy("cluster").limit(2).collect()]
    return L.merge_clusters(rows, first)


@query("clusters_list", "SELECT cluster, count(*) AS n, min(cell) AS first_cell, max(cell) AS last_cell FROM types GROUP BY 1")
def clusters_list(spark, sf):
    ds = dataset(spark, sf)
    out = L.to_lists(types(ds, sf))
    return out.select("cluster", F.size("elements").cast("long").alias("n"), F.element_at("elements", 1).alias("first_cell"), F.element_at("elements", -1).alias("last_cell"))


def without_first(labels: DataFrame) -> DataFrame:
    """Labels without those of the first cluster: its cells are in no list."""
    first = labels.agg(F.min("cluster").alias("first")).first()["first"]
    return labels.where(F.col("cluster") != F.lit(first))


@query("from_lists", "SELECT cs.cell, coalesce(cluster, '-1') AS cluster FROM cs LEFT JOIN (SELECT * FROM types WHERE cluster <> (SELECT min(cluster) FROM types)) t USING (cell)")
def from_lists(spark, sf):
    ds = dataset(spark, sf)
    return L.from_lists(L.to_lists(without_first(types(ds, sf))), ds.cells)


@query("grouped_positions", "SELECT cell, coalesce(cluster, '-1') AS cluster, row_number() OVER (ORDER BY cluster IS NULL, cluster, cell)::INT AS place FROM cs LEFT JOIN (SELECT * FROM types WHERE cluster <> (SELECT min(cluster) FROM types)) t USING (cell)")
def grouped_positions(spark, sf):
    ds = dataset(spark, sf)
    return L.grouped_positions(without_first(types(ds, sf)), ds.cells)


@query("condition_from_name", "SELECT p_name AS cell, split_part(p_name, ' ', 2) AS condition FROM part")
def condition_from_name(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("cell"))
    return L.condition_from_name(rows)


@query("nice_levels", "SELECT DISTINCT p_size, lpad(p_size::VARCHAR, (SELECT max(length(p_size::VARCHAR)) FROM part)::INT, '0') AS level FROM part")
def nice_levels(spark, sf):
    return L.nice_levels(spark.read.parquet(f"{sf}/part.parquet").select("p_size").distinct(), "p_size")


@query("renumbered", "SELECT cell, lpad(dense_rank() OVER (ORDER BY cluster)::VARCHAR, 1, '0') AS cluster FROM types")
def renumbered(spark, sf):
    ds = dataset(spark, sf)
    return L.renumber(types(ds, sf))


# uniformity


@query(
    "uniformity_simple",
    "SELECT round(f, 6) AS fraction_beyond, round(q, 4) AS quantile_at_ratio, f <= 0.01 AS is_uniform, round(q - 1.4, 4) AS shift FROM (SELECT avg((gdi >= 1.4)::INT) AS f, quantile_cont(gdi, 0.99) AS q FROM gdi)",
    PAIRS + gdi_sql(),
)
def uniformity_simple(spark, sf):
    done = U.SimpleCheck().check(S.gdi(fitted(spark, sf)), 1)
    row = (done.check_.fraction_beyond, done.check_.quantile_at_ratio, done.is_uniform, done.shift_to_uniformity())
    out = spark.createDataFrame([row], "fraction_beyond double, quantile_at_ratio double, is_uniform boolean, shift double")
    return out.select(r6("fraction_beyond").alias("fraction_beyond"), r6("quantile_at_ratio", 4).alias("quantile_at_ratio"), "is_uniform", r6("shift", 4).alias("shift"))


@query(
    "uniformity_advanced",
    "SELECT f1 <= 0.05 AND ((f2 >= 0.02 AND f3 <= 0.01) OR CASE WHEN n4 > 0 THEN n4 < 2 ELSE q4 <= 1.4 END) AS is_uniform, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3, n4, round(q4, 4) AS q4 FROM (SELECT avg((gdi >= 1.297)::INT) AS f1, avg((gdi >= 1.307)::INT) AS f2, avg((gdi >= 1.4)::INT) AS f3, count(*) FILTER (gdi >= 1.4) AS n4, (SELECT gdi FROM gdi ORDER BY gdi DESC LIMIT 1 OFFSET 1) AS q4 FROM gdi)",
    PAIRS + gdi_sql(),
)
def uniformity_advanced(spark, sf):
    from tessera.dataset import checkpoint

    done = U.AdvancedCheck().check(checkpoint(S.gdi(fitted(spark, sf))), 1)
    row = (done.is_uniform, done.first.fraction_beyond, done.second.fraction_beyond, done.third.fraction_beyond, done.fourth.threshold_rank, done.fourth.quantile_at_rank)
    out = spark.createDataFrame([row], "is_uniform boolean, f1 double, f2 double, f3 double, n4 long, q4 double")
    return out.select("is_uniform", *[r6(c).alias(c) for c in ("f1", "f2", "f3")], "n4", r6("q4", 4).alias("q4"))


# plot data


@query("size_curve", "SELECT cell, condition AS sample, size, row_number() OVER (PARTITION BY condition ORDER BY size DESC, cell)::INT AS rank FROM cs JOIN brands USING (cell)")
def size_curve(spark, sf):
    ds = dataset(spark, sf)
    return V.size_curve(ds, brands(ds, sf))


def _quartile_sql(v: str) -> str:
    qs = ", ".join(f"quantile_cont({v}, {q}) OVER (PARTITION BY condition) AS q{i}" for i, q in enumerate((0.25, 0.5, 0.75), 1))
    return f"SELECT cell, condition AS sample, {v}, row_number() OVER (PARTITION BY condition ORDER BY {v}, cell)::INT AS rank, {qs} FROM cs JOIN brands USING (cell)"


@query("cell_size_plot", _quartile_sql("size"))
def cell_size_plot(spark, sf):
    ds = dataset(spark, sf)
    return V.cell_size_plot(ds, brands(ds, sf))


@query("genes_size_plot", _quartile_sql("n_genes"))
def genes_size_plot(spark, sf):
    ds = dataset(spark, sf)
    return V.genes_size_plot(ds, brands(ds, sf))


@query("genes_percentage", f'SELECT cell, condition AS sample, size, coalesce(s, 0) AS "sum", round(100.0::DOUBLE * coalesce(s, 0) / size, 6) AS percentage FROM cs JOIN brands USING (cell) LEFT JOIN (SELECT cell, sum(n)::BIGINT AS s FROM counts WHERE gene IN {SUBSET} GROUP BY 1) USING (cell)')
def genes_percentage(spark, sf):
    ds = dataset(spark, sf)
    return V.genes_percentage(ds, GENES, conditions=brands(ds, sf)).withColumn("percentage", r6("percentage"))


@query("mitochondrial_percentage", "SELECT cell, condition AS sample, size, coalesce(s, 0) AS sum_mit, round(100.0::DOUBLE * coalesce(s, 0) / size, 6) AS mit_percentage FROM cs JOIN brands USING (cell) LEFT JOIN (SELECT cell, sum(n)::BIGINT AS s FROM counts WHERE regexp_matches(gene::VARCHAR, '^1') GROUP BY 1) USING (cell)")
def mitochondrial_percentage(spark, sf):
    ds = dataset(spark, sf)
    return V.mitochondrial_percentage(ds, "^1", brands(ds, sf)).withColumn("mit_percentage", r6("mit_percentage"))


@query("scatter", "SELECT cell, condition AS sample, size, n_genes FROM cs JOIN brands USING (cell)")
def scatter(spark, sf):
    ds = dataset(spark, sf)
    return V.scatter(ds, brands(ds, sf))


@query(
    "sorted_nu",
    "SELECT rank, round(nu, 6) AS nu, round(second, 6) + 0 AS second, round((SELECT nu - 0.005 FROM ss WHERE rank = 1 + (SELECT max(rank) FROM ss WHERE second < -0.01)), 6) AS threshold FROM ss",
    "ss AS (SELECT row_number() OVER w AS rank, nu, lead(nu, 2) OVER w - 2 * lead(nu, 1) OVER w + nu AS second FROM (SELECT * FROM cells ORDER BY nu, cell LIMIT 100) WINDOW w AS (ORDER BY nu, cell)),\n",
)
def sorted_nu(spark, sf):
    out = V.sorted_nu(linear(spark, sf))
    return out.select(F.col("rank").cast("long").alias("rank"), r6("nu").alias("nu"), r6("second").alias("second"), r6("threshold").alias("threshold"))


@query("scree", "SELECT gene AS component, round(sd * sd / sum(sd * sd) OVER (), 9) AS share FROM (SELECT gene, size::DOUBLE AS sd FROM gs)")
def scree(spark, sf):
    rows = R.gene_sizes(dataset(spark, sf)).select(F.col("gene").alias("component"), F.col("size").cast("double").alias("sd"))
    return V.scree(rows).select("component", r6("share", 9).alias("share"))


@query(
    "gdi_plot",
    'SELECT gene, round(sum_raw_norm, 6) AS sum_raw_norm, round(gdi, 4) AS gdi, coalesce("group", \'none\') AS "group", round(quantile_cont(gdi, 0.5) OVER (), 4) AS q50, round(quantile_cont(gdi, 0.75) OVER (), 4) AS q75 FROM gdi JOIN nun USING (gene) LEFT JOIN grp USING (gene) WHERE gdi > -5',
    PAIRS + gdi_sql() + GROUP_SQL,
)
def gdi_plot(spark, sf):
    out = V.gdi_plot(fitted(spark, sf), groups(spark))
    return out.select("gene", r6("sum_raw_norm").alias("sum_raw_norm"), r6("gdi", 4).alias("gdi"), "group", r6("q50", 4).alias("q50"), r6("q75", 4).alias("q75"))


PV = f"pv AS (SELECT b.x1, b.x2, b.coex, {tail_sql('s.s')} AS p FROM both_ b JOIN s USING (x1, x2) WHERE b.x2 IN {SUBSET}),\n"


@query(
    "heatmap",
    f'SELECT g.gene AS x2, grp.gene AS x1, round(CASE WHEN p IS NULL OR p > 0.5 OR grp.gene = g.gene THEN 0 ELSE coex END, 6) + 0 AS coex, round(coalesce(p, 1), 6) AS p_value, \'all\' AS condition, "group" AS type, p IS NULL AS absent FROM grp CROSS JOIN (SELECT gene FROM gs WHERE gene IN {SUBSET}) g LEFT JOIN pv ON pv.x1 = grp.gene AND pv.x2 = g.gene',
    PAIRS + PV + GROUP_SQL,
)
def heatmap(spark, sf):
    out = V.heatmap(fitted(spark, sf), GENES, groups(spark).select("gene", F.col("group").alias("type")), 0.5, "all")
    return out.withColumn("coex", r6("coex")).withColumn("p_value", r6("p_value"))


@query("genes_heatmap", "SELECT x1, x2, round(CASE WHEN x1 = x2 THEN 0 ELSE coex END, 6) + 0 AS coex, round(p, 6) AS p_value FROM pv WHERE x1 IN (SELECT x1 FROM pv WHERE p < 0.2 AND coex > 0 AND x1 <> x2)", PAIRS + PV)
def genes_heatmap(spark, sf):
    return V.genes_heatmap(fitted(spark, sf), GENES, 0.2).withColumn("coex", r6("coex")).withColumn("p_value", r6("p_value"))


@query(
    "cluster_summary_plot",
    "SELECT cluster, condition, measure, round(value, 6) AS value FROM lo UNPIVOT INCLUDE NULLS (value FOR measure IN (cell_number, cell_percentage, mean_ude, median_ude, exp_genes_25, exp_genes))",
    SUMMARY
    + "lo AS (SELECT cluster, condition, cell_number::DOUBLE AS cell_number, cell_percentage, mean_ude, median_ude, exp_genes_25::DOUBLE AS exp_genes_25, exp_genes::DOUBLE AS exp_genes FROM su),\n",
)
def cluster_summary_plot(spark, sf):
    ds = linear(spark, sf)
    return V.cluster_summary_plot(ds, types(ds, sf), brands(ds, sf)).withColumn("value", r6("value"))


@query(
    "markers_heatmap",
    'SELECT "group", gene, cluster, round(coex, 6) + 0 AS dea, round(q, 6) AS adj_p_value, CASE WHEN q IS NULL THEN \'\' WHEN q < 0.001 THEN \'***\' WHEN q < 0.01 THEN \'**\' WHEN q < 0.05 THEN \'*\' WHEN q < 0.1 THEN \'.\' ELSE \'\' END AS mark FROM grp CROSS JOIN (SELECT DISTINCT cluster FROM types) LEFT JOIN (SELECT dea.gene, dea.cluster, coex, least(1, p * dp.g) AS q FROM dea JOIN dp USING (gene, cluster)) USING (gene, cluster)',
    DEA + GROUP_SQL,
)
def markers_heatmap(spark, sf):
    ds = fitted(spark, sf)
    return V.markers_heatmap(ds, groups(spark), types(ds, sf)).withColumn("dea", r6("dea")).withColumn("adj_p_value", r6("adj_p_value"))


@query(
    "genes_blocks",
    "SELECT r.x2 AS row_marker, b.x1, c.x2 AS column_marker, b.x2, round(b.coex, 6) + 0 AS coex FROM both_ b JOIN near r ON r.x1 = b.x1 JOIN near c ON c.x1 = b.x2",
    PAIRS + PV + "near AS (SELECT x1, x2 FROM pv WHERE p < 0.2 AND coex > 0 AND x1 <> x2),\n",
)
def genes_blocks(spark, sf):
    return V.genes_blocks(fitted(spark, sf), GENES, limit=0.2)[0].withColumn("coex", r6("coex"))


@query("distance_canberra", f"SELECT a.cluster AS c1, b.cluster AS c2, round(sum(abs(a.coex - b.coex) / nullif(abs(a.coex) + abs(b.coex), 0)), 4) AS distance FROM dea a JOIN dea b ON a.gene = b.gene AND a.cluster < b.cluster GROUP BY 1, 2", DEA)
def distance_canberra(spark, sf):
    ds = fitted(spark, sf)
    return C.cluster_distances(ds, types(ds, sf), distance="canberra").select("c1", "c2", r6("distance", 4).alias("distance"))


@query("distance_correlation", f"SELECT a.cluster AS c1, b.cluster AS c2, round(1 - corr(a.coex, b.coex), 6) AS distance FROM dea a JOIN dea b ON a.gene = b.gene AND a.cluster < b.cluster GROUP BY 1, 2", DEA)
def distance_correlation(spark, sf):
    ds = fitted(spark, sf)
    return C.cluster_distances(ds, types(ds, sf), distance="correlation").select("c1", "c2", r6("distance").alias("distance"))
