"""Pair statistics: contingency tables, co-expression (COEX), S, G, p-values, PDI.

Observed counts come from a self-join of the sparse counts. Expected ones are a dense product over
the distinct efficiencies; blocks of genes are multiplied in numpy, one pair of blocks a group, so a
group's size is fixed and the number of groups grows with the pairs that the result has anyway.
``actOnCells`` forms swap the roles of genes and cells (``cells=True``).
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.algos.solvers import zero_probability
from tessera.dataset import DATASET_TAGS, SMALL, CountDataset, checkpoint, maybe_broadcast
from tessera.functions.special import chi_square_tail, log_neg_log
from tessera.operators.dense import Strip, by_strips, cells_of, tail
from tessera.operators.model import MOST_VALUES, histogram, nodes

#: Genes of a block, and distinct efficiencies that are multiplied at once.
BLOCK, SLICE = 256, 16_384


def _axis(ds: CountDataset, cells: bool) -> tuple[str, str, DataFrame, int, int]:
    """(key, other key, names, number of names, number of the others)."""
    return ("cell", "gene", ds.cells, ds.n_cells, ds.n_genes) if cells else ("gene", "cell", ds.genes, ds.n_genes, ds.n_cells)


def _names(ds: CountDataset, cells: bool, subset: list | None) -> DataFrame | None:
    key, _, names, *_ = _axis(ds, cells)
    if not subset:
        return None
    found = names.where(F.col(key).isin(list(subset))).select(key)
    if found.count() != len(set(subset)):
        raise ValueError(f"unknown {key}")
    return found


def _only(table: DataFrame, key: str, chosen: DataFrame | None) -> DataFrame:
    return table if chosen is None else table.join(F.broadcast(chosen), key, "left_semi")


def observed_yy(ds: CountDataset, cells: bool = False, subset: list | None = None, rows_of: list | None = None) -> DataFrame:
    """``x1, x2, yy``: in how many cells both genes occur; pairs that never meet are left out.

    Without a subset pairs are in order of ``pos`` (x1 up to x2), with one x2 is in the subset, and x1 in ``rows_of`` if given.
    """
    key, other, names, n, _ = _axis(ds, cells)
    if subset:
        right, left = (_only(ds.counts, key, _names(ds, cells, some)) for some in (subset, rows_of))
        right = right.select(F.col(other).alias("o"), F.col(key).alias("x2"))
        left = left.select(F.col(other).alias("o"), F.col(key).alias("x1"))
        return left.join(maybe_broadcast(right, right.count()), "o").groupBy("x1", "x2").agg(F.count(F.lit(1)).alias("yy"))
    rows = ds.counts.join(maybe_broadcast(names.select(key, "pos"), n), key)
    left = rows.select(F.col(other).alias("o"), F.col(key).alias("x1"), F.col("pos").alias("p1"))
    right = rows.select(F.col(other).alias("o"), F.col(key).alias("x2"), F.col("pos").alias("p2"))
    return left.join(right, "o").where("p1 <= p2").groupBy("x1", "x2").agg(F.count(F.lit(1)).alias("yy"))


def _profiles(ds: CountDataset, cells: bool) -> tuple[DataFrame, str, object]:
    """Rows whose zero probabilities are multiplied, their columns, and the function that makes them."""
    if cells:
        genes = ds.genes.groupBy("lambda", "dispersion").agg(F.count(F.lit(1)).alias("m")).limit(MOST_VALUES + 1).toPandas()
        if len(genes) > MOST_VALUES:
            raise ValueError("more distinct genes than one task should hold")
        lam, a, m = (genes[c].to_numpy(float) for c in ("lambda", "dispersion", "m"))

        def profile(part: pd.DataFrame, s: slice) -> np.ndarray:
            return zero_probability(a[None, s], part["nu"].to_numpy(float)[:, None] * lam[None, s])

        return ds.cells.select(F.col("cell").alias("x"), "pos", "nu"), "nu double", (profile, m)
    values = histogram(ds)
    nu, m = nodes(values["nu"].to_numpy(float), values["m"].to_numpy(float))

    def profile(part: pd.DataFrame, s: slice) -> np.ndarray:
        return zero_probability(part["dispersion"].to_numpy(float)[:, None], part["lambda"].to_numpy(float)[:, None] * nu[None, s])

    return ds.genes.select(F.col("gene").alias("x"), "pos", "lambda", "dispersion"), "lambda double, dispersion double", (profile, m)


def expected_nn(ds: CountDataset, cells: bool = False, subset: list | None = None, rows_of: list | None = None) -> DataFrame:
    """``x1, x2, nn, n1, n2``: expected number without either, and without each, for all pairs; of a subset and ``rows_of`` as by ``observed_yy``."""
    rows, _, (profile, m) = _profiles(ds, cells)
    key, _, _, n, _ = _axis(ds, cells)
    kind = rows.schema["x"].dataType.simpleString()
    blocks = max(1, -(-n // BLOCK))
    chosen = _names(ds, cells, subset)
    own = F.pmod(F.col("pos"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("own", own)
    ids = F.sequence(F.lit(0), F.lit(blocks - 1))
    if chosen is None:
        pairs = dealt.withColumn("with_", F.explode(ids)).select("*", F.least("own", "with_").alias("b1"), F.greatest("own", "with_").alias("b2"))
    else:
        right = dealt.join(maybe_broadcast(chosen.withColumnRenamed(key, "x"), len(subset)), "x", "left_semi").withColumn("side", F.lit(2))
        some = _names(ds, cells, rows_of)
        pairs = _only(dealt, "x", some and some.withColumnRenamed(key, "x")).withColumn("side", F.lit(1)).unionByName(right).withColumn("b1", F.when(F.col("side") == 1, F.col("own")))
        left, right = pairs.where("side = 1"), pairs.where("side = 2").drop("b1").withColumn("b1", F.explode(ids))
        pairs = left.unionByName(right).withColumn("b2", F.lit(0))
    whole = chosen is None

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        if whole:
            left, right = part[part["own"] == part["b1"].iloc[0]], part[part["own"] == part["b2"].iloc[0]]
        else:
            left, right = part[part["side"] == 1], part[part["side"] == 2]
        nn, n1, n2 = np.zeros((len(left), len(right))), np.zeros(len(left)), np.zeros(len(right))
        for at in range(0, len(m), SLICE):  # the profiles are multiplied a slice at a time
            s = slice(at, at + SLICE)
            a, b = profile(left, s), profile(right, s)
            nn += (a * m[s]) @ b.T
            n1 += a @ m[s]
            n2 += b @ m[s]
        i, j = np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij")
        i, j = i.ravel(), j.ravel()
        out = pd.DataFrame(
            {"x1": left["x"].to_numpy()[i], "x2": right["x"].to_numpy()[j], "nn": nn[i, j], "n1": n1[i], "n2": n2[j]}
        )
        if whole:
            p1, p2 = left["pos"].to_numpy()[i], right["pos"].to_numpy()[j]
            swap = p1 > p2
            out.loc[swap, ["x1", "x2", "n1", "n2"]] = out.loc[swap, ["x2", "x1", "n2", "n1"]].to_numpy()
            if part["b1"].iloc[0] == part["b2"].iloc[0]:
                out = out[~swap]
        return out

    return pairs.groupBy("b1", "b2").applyInPandas(multiply, f"x1 {kind}, x2 {kind}, nn double, n1 double, n2 double")


def _marginals(ds: CountDataset, cells: bool) -> DataFrame:
    key, _, names, n, _ = _axis(ds, cells)
    made = ds.counts.groupBy(key).agg(F.count(F.lit(1)).alias("y"))
    return maybe_broadcast(names.select(F.col(key).alias("x"), "pos").join(made.withColumnRenamed(key, "x"), "x", "left").na.fill(0, ["y"]), n)


def observed_tables(ds: CountDataset, cells: bool = False, subset: list | None = None) -> DataFrame:
    """``x1, x2, nn, ny, yn, yy`` of all pairs: first letter for x1, second for x2."""
    _, _, _, n, others = _axis(ds, cells)
    each = _marginals(ds, cells)
    left = each.select(F.col("x").alias("x1"), F.col("pos").alias("p1"), F.col("y").alias("y1"))
    right = each.select(F.col("x").alias("x2"), F.col("pos").alias("p2"), F.col("y").alias("y2"))
    chosen = _names(ds, cells, subset)
    if chosen is not None:
        right = right.join(maybe_broadcast(chosen.toDF("x2"), len(subset)), "x2", "left_semi")
    if chosen is not None:
        grid = left.crossJoin(right)
    else:  # by pairs of blocks, so that it is a join on a key
        last = F.floor(F.lit(n - 1) / BLOCK)
        left = left.withColumn("block", F.explode(F.sequence(F.floor(F.col("p1") / BLOCK), last)))
        grid = left.join(right.withColumn("block", F.floor(F.col("p2") / BLOCK)), "block").where("p1 <= p2")
    both = grid.join(observed_yy(ds, cells, subset), ["x1", "x2"], "left").withColumn("yy", F.coalesce("yy", F.lit(0)))
    yn, ny = F.col("y1") - F.col("yy"), F.col("y2") - F.col("yy")
    return both.select("x1", "x2", (F.lit(others) - F.col("yy") - yn - ny).alias("nn"), ny.alias("ny"), yn.alias("yn"), "yy")


def expected_tables(ds: CountDataset, cells: bool = False, subset: list | None = None, rows_of: list | None = None) -> DataFrame:
    """``x1, x2, nn, ny, yn, yy`` as the model expects them."""
    _, _, _, _, others = _axis(ds, cells)
    ny, yn = F.col("n1") - F.col("nn"), F.col("n2") - F.col("nn")
    return expected_nn(ds, cells, subset, rows_of).select("x1", "x2", "nn", ny.alias("ny"), yn.alias("yn"), (F.lit(float(others)) - F.col("nn") - ny - yn).alias("yy"))


def both_tables(ds: CountDataset, cells: bool = False, subset: list | None = None, rows_of: list | None = None) -> DataFrame:
    """Expected (e_*) and observed (o_*) tables of all pairs, side by side; of a subset and ``rows_of`` as by ``observed_yy``."""
    _, _, _, n, others = _axis(ds, cells)
    each = _marginals(ds, cells)
    e = expected_tables(ds, cells, subset, rows_of).select("x1", "x2", *[F.col(c).alias(f"e_{c}") for c in ("nn", "ny", "yn", "yy")])
    joined = (
        e.join(observed_yy(ds, cells, subset, rows_of), ["x1", "x2"], "left")
        .join(each.select(F.col("x").alias("x1"), F.col("y").alias("y1")), "x1")
        .join(each.select(F.col("x").alias("x2"), F.col("y").alias("y2")), "x2")
        .withColumn("o_yy", F.coalesce("yy", F.lit(0)))
    )
    yn, ny = F.col("y1") - F.col("o_yy"), F.col("y2") - F.col("o_yy")
    return joined.select(
        "x1", "x2", "e_nn", "e_ny", "e_yn", "e_yy", (F.lit(others) - F.col("o_yy") - yn - ny).alias("o_nn"), ny.alias("o_ny"), yn.alias("o_yn"), "o_yy"
    )


CELLS_OF_TABLE = ("nn", "ny", "yn", "yy")


def coex_value(others: int) -> Column:
    """(observed - expected) of both present, over its deviation."""
    spread = sum((1 / F.greatest(F.lit(1.0), F.col(f"e_{c}")) for c in CELLS_OF_TABLE), F.lit(0.0))
    return (F.col("o_yy") - F.col("e_yy")) * F.sqrt(spread / others)


def in_strips(ds: CountDataset, make, columns: str, cells: bool = False, both: bool = True) -> DataFrame | None:
    """What ``make`` yields of each strip of the square matrix; None where there are too many names to send along."""
    if _axis(ds, cells)[3] > SMALL:
        return None
    return by_strips(ds, _axis(ds, cells), _profiles(ds, cells), make, columns, both)


def _matrix(ds: CountDataset, value, name: str, cells: bool = False, both: bool = True) -> DataFrame | None:
    return in_strips(ds, lambda strip: cells_of(strip, lambda cols: value(strip, cols), both), f"x1 name, x2 name, {name} double", cells, both)


def coex(ds: CountDataset, cells: bool = False, subset: list | None = None, rows_of: list | None = None) -> DataFrame:
    """``x1, x2, coex`` of all pairs, or of all with a subset (x2), or of some names (x1) with it."""
    if not subset and (made := _matrix(ds, Strip.coex, "coex", cells, both=False)) is not None:
        return made
    return both_tables(ds, cells, subset, rows_of).select("x1", "x2", coex_value(_axis(ds, cells)[4]).alias("coex"))


def small_expected_fraction(ds: CountDataset, cells: bool = False) -> DataFrame:
    """One row ``fraction``: pairs whose smallest expected count is below one half."""
    least = F.least(*[F.col(c) for c in CELLS_OF_TABLE])
    return expected_tables(ds, cells).agg(F.avg((least < 0.5).cast("double")).alias("fraction"))


#: Pairs that leave a stored row's task at once.
UNPACKED = 250_000


def stored_coex(ds: CountDataset, cells: bool = False) -> DataFrame:
    """``coex`` of all pairs, written out: eight bytes a pair, a list of doubles for each name, which gets its names back when read."""

    def triangle(strip: Strip):
        whole = np.concatenate([strip.coex(cols) for cols in strip.slices()], axis=1)
        yield pa.array(np.arange(strip.first, strip.last)), pa.array([r[k:].tobytes() for k, r in enumerate(whole)], pa.binary())

    packed = in_strips(ds, triangle, "i long, data binary", cells, both=False)
    if packed is None:
        return checkpoint(coex(ds, cells))
    packed = checkpoint(packed)
    key, _, table, *_ = _axis(ds, cells)
    names = table.orderBy("pos").select(key).toArrow().column(key).combine_chunks()
    kind, n = table.schema[key].dataType.simpleString(), len(names)

    def unpack(batches):
        for batch in batches:
            for i, data in zip(batch.column("i").to_pylist(), batch.column("data"), strict=True):
                values = np.frombuffer(data.as_buffer())
                for at in range(0, n - i, UNPACKED):
                    some = values[at : at + UNPACKED]
                    first = names.take(pa.array(np.full(len(some), i)))
                    yield pa.RecordBatch.from_arrays([first, names.slice(i + at, len(some)), pa.array(some)], ["x1", "x2", "coex"])

    return packed.mapInArrow(unpack, f"x1 {kind}, x2 {kind}, coex double")


def calculate_coex(ds: CountDataset, cells: bool = False, fraction: bool = False) -> CountDataset:
    """Stores COEX, marks it as in sync and, if asked for, notes the fraction of small expected counts."""
    made = stored_coex(ds, cells)
    out = replace(ds, cell_coex=made) if cells else replace(ds, gene_coex=made)
    note = small_expected_fraction(ds, cells).first()[0] if fraction else "NA"
    return out.add_metadata(DATASET_TAGS[5 if cells else 4], "TRUE").add_metadata(DATASET_TAGS[7 if cells else 6], note)


def coex_available(ds: CountDataset, cells: bool = False, ignore_sync: bool = False) -> bool:
    return (ds.cell_coex if cells else ds.gene_coex) is not None and (ignore_sync or ds.in_sync(cells))


def drop_coex(ds: CountDataset, cells: bool = False) -> CountDataset:
    out = replace(ds, cell_coex=None) if cells else replace(ds, gene_coex=None)
    return out.add_metadata(DATASET_TAGS[5 if cells else 4], "FALSE")


def symmetric(pairs: DataFrame, value: str) -> DataFrame:
    """Both orders of each pair."""
    return pairs.unionByName(pairs.where("x1 <> x2").select(F.col("x2").alias("x1"), F.col("x1").alias("x2"), value))


def get_coex(ds: CountDataset, subset: list | None = None, cells: bool = False, zero_diagonal: bool = True, ignore_sync: bool = False) -> DataFrame:
    """The stored matrix (both orders), or a partial one computed where it is stale."""
    if coex_available(ds, cells, ignore_sync):
        full = symmetric(ds.cell_coex if cells else ds.gene_coex, "coex")
        out = full.where(F.col("x2").isin(list(subset))) if subset else full
    elif subset:
        out = coex(ds, cells, subset)
    else:
        raise ValueError("COEX is missing or out of date")
    return out.withColumn("coex", F.when(F.col("x1") == F.col("x2"), 0.0).otherwise(F.col("coex"))) if zero_diagonal else out


def s_statistic(ds: CountDataset, cells_subset: list | None = None) -> DataFrame:
    """``x1, x2, s``: coex squared times the number of cells, 0 on the diagonal."""
    if not cells_subset and ds.gene_coex is None and (made := _matrix(ds, Strip.s, "s")) is not None:
        return made
    pairs = symmetric(ds.gene_coex if ds.gene_coex is not None else coex(ds), "coex") if not cells_subset else get_coex(ds, cells_subset)
    return pairs.select("x1", "x2", F.when(F.col("x1") == F.col("x2"), 0.0).otherwise(F.col("coex") * F.col("coex") * ds.n_cells).alias("s"))


def g_statistic(ds: CountDataset, subset: list | None = None) -> DataFrame:
    """``x1, x2, s``: twice the sum of o ln(o / max(1, e)), 0 on the diagonal."""
    if not subset and (made := _matrix(ds, Strip.g, "s")) is not None:
        return made
    term = lambda c: F.when(F.col(f"o_{c}") == 0, 0.0).otherwise(F.col(f"o_{c}") * F.log(F.col(f"o_{c}") / F.greatest(F.lit(1.0), F.col(f"e_{c}"))))
    total = 2 * (term("nn") + term("ny") + term("yn") + term("yy"))
    out = both_tables(ds, subset=subset).select("x1", "x2", F.when(F.col("x1") == F.col("x2"), 0.0).otherwise(total).alias("s"))
    return out if subset else symmetric(out, "s")


def statistic(ds: CountDataset, kind: str = "S", subset: list | None = None) -> DataFrame:
    if kind not in ("S", "G"):
        raise ValueError(f"unknown statistic {kind}")
    return s_statistic(ds, subset) if kind == "S" else g_statistic(ds, subset)


def statistic_of(ds: CountDataset, kind: str):
    """The function of a strip that makes the statistic, where it need not come from a stored table."""
    return {"S": Strip.s if ds.gene_coex is None else None, "G": Strip.g}.get(kind)


def p_values(ds: CountDataset, kind: str = "S", subset: list | None = None) -> DataFrame:
    own = statistic_of(ds, kind)
    if not subset and own and (made := _matrix(ds, lambda strip, cols: tail(own(strip, cols)), "p_value")) is not None:
        return made
    return statistic(ds, kind, subset).select("x1", "x2", chi_square_tail(F.col("s")).alias("p_value"))


def pdi(ds: CountDataset, kind: str = "S", subset: list | None = None, above: float | None = None) -> DataFrame:
    """ln(-ln p) of each pair; of two different genes whose statistic is larger than ``above``, if that is given."""
    if above is None:
        return p_values(ds, kind, subset).select("x1", "x2", log_neg_log(F.col("p_value")).alias("pdi"))
    own = statistic_of(ds, kind)

    def make(strip: Strip):
        for cols in strip.slices():
            s = own(strip, cols)
            i, j = np.nonzero((s > above) & ~strip.diagonal(cols))
            with np.errstate(divide="ignore"):
                value = np.log(-np.log(tail(s[i, j])))
            yield strip.names.take(pa.array(strip.first + i)), strip.names.take(pa.array(strip.start + cols.start + j)), value

    if not subset and own and (made := in_strips(ds, make, "x1 name, x2 name, pdi double")) is not None:
        return made
    rows = statistic(ds, kind, subset).where((F.col("x1") != F.col("x2")) & (F.col("s") > above))
    return rows.select("x1", "x2", log_neg_log(chi_square_tail(F.col("s"))).alias("pdi"))


def contingency_pair(ds: CountDataset, g1, g2) -> DataFrame:
    """One row with the expected and observed table of two genes."""
    return both_tables(ds, subset=[g2]).where((F.col("x1") == F.lit(g1)) & (F.col("x2") == F.lit(g2)))


def pack_position(i: Column, j: Column, n: int) -> Column:
    """Place of (i >= j) in the packed lower triangle of an n x n matrix, by columns, from 0."""
    return j * n - (j * (j - 1) / 2).cast("long") + i - j


def unpack(vector: DataFrame, names: DataFrame) -> DataFrame:
    """``position, value`` of a packed lower triangle -> ``x1, x2, value`` (x1 at or below x2).

    Row and column are computed from the position, so the vector meets only the names.
    """
    n = names.count()
    p, wide = F.col("position"), float(2 * n + 1)
    guess = F.floor((F.lit(wide) - F.sqrt(F.greatest(F.lit(0.0), F.lit(wide * wide) - 8 * p))) / 2).cast("long")
    start = lambda j: j * n - (j * (j - 1) / 2).cast("long")
    # the root may be off by its last bit
    j = F.when(start(guess) > p, guess - 1).when(start(guess + 1) <= p, guess + 1).otherwise(guess)
    placed = vector.where((p >= 0) & (p < n * (n + 1) // 2)).withColumn("j", j).withColumn("i", F.col("j") + p - start(F.col("j")))
    r, c = (maybe_broadcast(names.select(F.col("name").alias(x), F.col("pos").alias(k)), n) for x, k in (("x1", "i"), ("x2", "j")))
    return placed.join(r, "i").join(c, "j").select("x1", "x2", "value")
