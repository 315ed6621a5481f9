"""Approximate nearest neighbours: NN-descent by Spark joins, queries by greedy search in its graph.

Equal vectors become one node (its members are put back at the end, so ties are exact). The graph
starts from random hyperplanes: nodes in the order of their sign code are compared in runs of
``RUN`` under ``TREES`` sets of planes. Each round of NN-descent then joins every node's neighbours,
forward and reverse, with their vectors, compares neighbours of one node with each other where one
of the two is new, and keeps for each node the ``DEGREE`` best it has met. A query walks the graph:
the best nodes it has met and not yet opened are opened, their neighbours are scored, until no
node among its ``POOL`` best is left unopened. Vectors travel as unit vectors of 32-bit floats and are
compared in double precision; all that a query has kept is scored exactly at the end, on the
original vectors.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, release, small_batches, table

TREES, RUN, FROM_RUN, DEGREE, REVERSE, FROM_NODE, ROUNDS, SEED = 16, 256, 8, 32, 16, 10, 4, 11
#: Vectors of queries of so many bytes in all are broadcast.
BROADCAST_BYTES = 64_000_000
#: Nodes that a query opens in one step, edges followed from each, nodes that it keeps, and the most steps (None: until it converges).
#: A step is a plan of its own on the driver, so few steps open many nodes each.
OPEN, LINKS, POOL, STEPS, TOP = 128, 64, 400, None, 5


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part: no null, NaN or infinity, not all zero."""
    v = F.col("vector")
    of = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return of.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite & F.exists(v, lambda x: x != 0))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as 32-bit floats."""
    for batch in batches:
        lists = batch.column("vector")
        x = np.asarray(lists.flatten(), np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
        x = scaled(x)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "unit"])


def _units(column: pa.Array) -> np.ndarray:
    """The unit vectors of a binary column, as doubles: near copies differ by less than a float of their similarity."""
    if not len(column):
        return np.zeros((0, 1))
    x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest values of each row."""
    k = min(k, sims.shape[1])
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cols = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(sims)), k), cols.ravel()


EDGES = "v long, u long, sim double"


def _edges(v: np.ndarray, u: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u), pa.array(sim.astype(np.float64))], names=["v", "u", "sim"])


def _coder(trees: int, bits: int, seed: int):
    """The sign codes of each node under each set of planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            x = _units(batch.column("unit"))
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], trees * bits)).astype(np.float32)
            signs = (x @ planes > 0).reshape(len(x), trees, bits)
            codes = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(codes[:, t]), batch.column("node"), batch.column("unit")],
                    names=["tree", "code", "node", "unit"],
                )

    return run


def _runs(length: int, degree: int):
    """Nodes in order -> the best edges inside runs of ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column("node").to_numpy(), _units(batch.column("unit"))
            for at in range(0, len(ids), length):
                own, y = ids[at : at + length], x[at : at + length]
                sims = y @ y.T
                np.fill_diagonal(sims, -2)
                rows, cols = _best(sims, min(degree, len(own) - 1))
                yield _edges(own[rows], own[cols], sims[rows, cols])

    return run


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows sorted by a key -> tables that end with a group, and where each of their groups is."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if kept and last == 0 and kept[-1].column(key)[-1].as_py() == keys[0]:
            kept.append(batch)
            continue
        yield from _cut(kept + [batch.slice(0, last)], key)
        kept = [batch.slice(last)]
    yield from _cut(kept, key)


def _cut(parts: list[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    parts = [p for p in parts if p.num_rows]
    if parts:
        whole = pa.Table.from_batches(parts).combine_chunks()
        keys = whole[key].to_numpy()
        edge = np.flatnonzero(np.diff(keys)) + 1
        yield whole, list(zip([0, *edge.tolist()], [*edge.tolist(), len(keys)], strict=True))


def _local_join(per_node: int):
    """Neighbours of a node -> edges between them that either side can use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, groups in groups_of(batches, "v"):
            u, fresh_, worst = (whole[c].to_numpy(zero_copy_only=False) for c in ("u", "fresh", "worst"))
            x = _units(whole["unit"].combine_chunks())
            out = []
            for i, j in groups:
                if j - i < 2 or not fresh_[i:j].any():
                    continue
                sims = x[i:j] @ x[i:j].T
                np.fill_diagonal(sims, -2)
                sims[~(fresh_[i:j, None] | fresh_[None, i:j])] = -2
                sims[sims <= worst[i:j, None]] = -2
                rows, cols = _best(sims, min(per_node, j - i - 1))
                good = sims[rows, cols] > -2
                rows, cols = rows[good], cols[good]
                out.append((u[i:j][rows], u[i:j][cols], sims[rows, cols]))
            if out:
                yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))

    return run


def _keep(edges: DataFrame, degree: int) -> DataFrame:
    """The best ``degree`` edges of each node, once each."""
    once = edges.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(W.partitionBy("v").orderBy(F.desc("sim"), "u"))
    return once.withColumn("rank", rank).where(F.col("rank") <= degree).drop("rank")


def build_graph(units: DataFrame, n: int, degree: int = DEGREE, rounds: int = ROUNDS, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """``node, unit`` -> the neighbour graph ``v, u, sim``."""
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, int(n / RUN).bit_length())
    coded = units.mapInArrow(_coder(trees, bits, seed), "tree int, code long, node long, unit binary")
    ordered = coded.repartitionByRange(parts, "tree", "code", "node").sortWithinPartitions("tree", "code", "node")
    start = ordered.mapInArrow(_runs(RUN, FROM_RUN), EDGES).withColumn("fresh", F.lit(True))
    graph = checkpoint(_keep(start, degree))
    for _ in range(rounds):
        worst = graph.groupBy("v").agg(F.when(F.count(F.lit(1)) >= degree, F.min("sim")).otherwise(F.lit(-2.0)).cast("double").alias("worst"))
        reverse = graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "sim", "fresh")
        # of a node's reverse neighbours the new ones come first, then the nearest
        rank = F.row_number().over(W.partitionBy("v").orderBy(F.desc("fresh"), F.desc("sim"), "u"))
        reverse = reverse.withColumn("rank", rank).where(F.col("rank") <= REVERSE).drop("rank")
        around = graph.unionByName(reverse).groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
        nodes = units.join(worst, F.col("node") == F.col("v")).select(F.col("node").alias("u"), "unit", "worst")
        local = around.join(nodes.hint("shuffle_hash"), "u").select("v", "u", "fresh", "worst", "unit")
        made = local.repartition(parts, "v").sortWithinPartitions("v").mapInArrow(_local_join(FROM_NODE), EDGES)
        after = graph.withColumn("fresh", F.lit(False)).unionByName(made.withColumn("fresh", F.lit(True)))
        graph = checkpoint(_keep(after, degree))
        release(units.sparkSession)
        if graph.where("fresh").count() < 0.002 * n * degree:
            break
    return graph.select("v", "u", "sim")


def _scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = _units(batch.column("query_unit")), _units(batch.column("unit"))
        yield _edges(batch.column("v").to_numpy(), batch.column("u").to_numpy(), np.einsum("ij,ij->i", a, b))


def _beside(asked: DataFrame) -> DataFrame:
    """The queries' vectors, to be joined to pairs: by broadcast where they are few enough, so that pairs move without vectors."""
    n = asked.count()
    size = n and n * (asked.agg(F.avg(F.octet_length("query_unit") if "query_unit" in asked.columns else 8 * F.size("query_vector")).alias("b")).first()["b"] + 16)
    return F.broadcast(asked) if size <= BROADCAST_BYTES else asked


def search_graph(graph: DataFrame, units: DataFrame, queries: DataFrame, pool: int = POOL, steps: int | None = STEPS, open_: int = OPEN) -> DataFrame:
    """``queries(v)``: nodes of the graph -> ``v, u, sim``: the nodes met on a greedy walk from each."""
    both = graph.select("v", "u", "sim").unionByName(graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "sim")).groupBy("v", "u").agg(F.max("sim").alias("sim"))
    near = W.partitionBy("v").orderBy(F.desc("sim"), "u")
    links = checkpoint(both.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= LINKS).select(F.col("v").alias("at"), F.col("u").alias("next")))
    asked = checkpoint(units.join(queries.select(F.col("v").alias("node")), "node", "left_semi").select(F.col("node").alias("v"), F.col("unit").alias("query_unit")))
    vectors = _beside(asked)
    met = checkpoint(graph.join(queries, "v", "left_semi").select("v", "u", "sim", F.lit(False).alias("opened")))
    for _ in itertools.count() if steps is None else range(steps):
        rank = F.row_number().over(W.partitionBy("v").orderBy("opened", F.desc("sim"), "u"))
        marked = met.withColumn("opening", (~F.col("opened")) & (rank <= open_))
        frontier = marked.where("opening").select("v", F.col("u").alias("at"))
        found = frontier.join(links, "at").select("v", F.col("next").alias("u")).where("u <> v").distinct().join(met.select("v", "u"), ["v", "u"], "left_anti")
        scored = found.join(units.select(F.col("node").alias("u"), "unit"), "u").join(vectors, "v").select("v", "u", "unit", "query_unit").mapInArrow(_scorer, EDGES)
        after = marked.select("v", "u", "sim", (F.col("opened") | F.col("opening")).alias("opened")).unionByName(scored.withColumn("opened", F.lit(False)))
        kept = checkpoint(after.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= pool).drop("rank"))
        met = kept
        release(units.sparkSession)
        if not met.where(~F.col("opened")).limit(1).count():
            break
    return met.select("v", "u", "sim")


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two above their largest component: exact, and no product of two rows overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (scaled(np.asarray(batch.column(c).flatten(), np.float64).reshape(batch.num_rows, -1)) for c in ("query_vector", "vector"))
            score = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])


def nearest(rows: DataFrame, query_every: int, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, **options) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest found for each row whose id is divisible by ``query_every``.

    Rows with a null id or vector, with a null, NaN or infinite component, or of zeros alone take no
    part, nor do rows of another dimension than most. Equal vectors tie and go by id; rows repeated
    under one id count once. If there are fewer other rows than ``top``, all are returned; a lone
    query returns no row. Other columns are ignored, an empty table gives an empty result. Components
    may be as large or small as a double: rows are scaled by powers of two, which changes no score.
    The walk may miss a neighbour; ``nearest_exact`` does not.
    """
    good = clean_vectors(small_batches(rows), id_col, vector_col)
    sizes = {r["d"]: r["n"] for r in good.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = rows.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    dimension = max(sizes, key=lambda d: (sizes[d], d))
    good = good.where(F.size("vector") == dimension).withColumn("hash", F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), 256))
    # of equal vectors the smallest ids are all that a result can hold: a bounded number for each node
    rank = F.row_number().over(W.partitionBy("hash").orderBy("vec_id"))
    first = checkpoint(good.dropDuplicates(["vec_id"]).withColumn("rank", rank).where(F.col("rank") <= top + 1))
    heads = first.where("rank = 1").select("hash", F.col("vec_id").alias("node"), "vector")
    units = checkpoint(heads.select("node", "vector").mapInArrow(_pack, "node long, unit binary"))
    members = checkpoint(first.join(heads.select("hash", "node"), "hash").select("node", "vec_id", "vector"))
    asked = good.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "vector", "hash")
    asked = checkpoint(asked.join(heads.select("hash", "node"), "hash").select("query_id", "node", F.col("vector").alias("query_vector")))
    n = units.count()
    graph = build_graph(units, n)
    walked = search_graph(graph, units, asked.select(F.col("node").alias("v")).distinct(), **options)
    itself = asked.select(F.col("node").alias("v"), F.col("node").alias("u")).distinct().withColumn("sim", F.lit(2.0))
    best = walked.unionByName(itself).select("v", "u")
    pairs = best.join(members.withColumnRenamed("node", "u"), "u").join(_beside(asked), F.col("v") == F.col("node")).drop("node").where("vec_id <> query_id")
    scored = pairs.select("query_id", "query_vector", "vec_id", "vector").mapInArrow(_exact, "query_id long, vec_id long, score double")
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", order).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest_exact(rows: DataFrame, query_every: int, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, block: int = 4096) -> DataFrame:
    """``nearest`` by comparing every query with every row, in blocks; rows that take no part are the same.

    Queries are dealt to blocks of ``block``, each of which meets all rows in passes over the table:
    the work grows with their product, the memory with a block. For measuring recall, and where
    nothing may be missed.
    """
    good = clean_vectors(small_batches(rows), id_col, vector_col).dropDuplicates(["vec_id"])
    sizes = {r["d"]: r["n"] for r in good.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = "query_id long, vec_id long, score double"
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = checkpoint(good.where(F.size("vector") == max(sizes, key=lambda d: (sizes[d], d))))
    asked = checkpoint(good.where(F.col("vec_id") % query_every == 0).withColumn("place", F.monotonically_increasing_id()))
    n = asked.count()
    parts = -(-n // block)
    asked = checkpoint(asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(max(parts, 1)))))
    found = []
    for p in range(parts):  # a block is bounded, so it goes with the task
        own = asked.where(F.col("part") == p).select("vec_id", "vector").toPandas()
        if len(own):
            found.append(good.mapInArrow(_against(own["vec_id"].to_numpy(), np.array(own["vector"].tolist()), top), out))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    every = reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], out)
    return every.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _against(ids: np.ndarray, vectors: np.ndarray, top: int):
    """The ``top`` rows of each task for each query of a block."""
    x = scaled(vectors)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            other, y = batch.column("vec_id").to_numpy(), scaled(np.asarray(batch.column("vector").flatten(), np.float64).reshape(batch.num_rows, -1))
            far = np.sqrt(np.einsum("ij,ij->i", y, y))
            for at in range(0, len(other), 512):
                own, z = other[at : at + 512], y[at : at + 512]
                score = np.stack([np.einsum("ij,j->i", x, v) for v in z], 1) / (norm[:, None] * far[at : at + 512])
                score[ids[:, None] == own[None]] = -np.inf
                both = (score, np.broadcast_to(own, score.shape)) if best is None else (np.concatenate([best[0], score], 1), np.concatenate([best[1], np.broadcast_to(own, score.shape)], 1))
                order = np.lexsort((both[1], -both[0]), axis=1)[:, :top]
                best = np.take_along_axis(both[0], order, 1), np.take_along_axis(both[1], order, 1)
        if best is not None:
            keep = np.isfinite(best[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, keep.sum(1))), pa.array(best[1][keep]), pa.array(best[0][keep])], names=["query_id", "vec_id", "score"]
            )

    return run


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op8``: the queries of ``embeddings`` against all its rows."""
    return nearest(table(spark, sf_dir, "embeddings"), 50)
