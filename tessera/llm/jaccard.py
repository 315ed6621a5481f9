"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity SimHash fingerprints of 64 bits differ in about 10 bits (0.15 of them), where no
choice of equal blocks tells copies from chance. So the fingerprints have ``BITS`` bits here, and the
shards of their BK-trees are the buckets of ``BANDS`` bands of ``ROWS`` MinHash values: a pair of
similarity 0.8 misses every bucket with a probability of ``(1 - 0.8 ** ROWS) ** BANDS``, about 1e-7.
Within the shards the trees link what lies within ``RADIUS`` bits: at 0.8 at most 0.19 of the bits
differ on average, so a link is missed about once in ten million pairs. The links' components are
groups of candidates. Each text of a group is sent once to a task (to as many as the group has parts,
where it has more than ``PART`` shingles), which finds the exact similarities through an index of the
shingles and returns a spanning forest of the pairs that reach 0.8. So no pair is decided by a
fingerprint, and no stage returns more than a row for each member of a shard or group and part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, fresh, join_counted, small_batches, trimmed
from tessera.llm.components import components
from tessera.llm.simhash import _hashes, dealt_in_parts, link_shards, sorted_groups

WORDS, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 40, 5, 42
#: Bits of a fingerprint, and of them those that may differ; shingles of a part of a group.
BITS, RADIUS, PART = 256, 80, 400_000
#: Hashes that are worked on at once; bits of the bitmap of row hashes: 16 a row, but no more than 2**27.
AT_ONCE, BITS_PER_ROW, LEAST_BITS, MAX_BITS = 2048, 16, 1 << 16, 1 << 27


def wide_print(h: np.ndarray, draws: np.ndarray) -> bytes:
    """SimHash of ``BITS`` bits of some 64-bit hashes, each of them drawn anew for every 64 bits."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(h), AT_ONCE):
        x = (h[at : at + AT_ONCE, None] ^ draws) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        count += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(h), bitorder="little").tobytes()


def _signer(words: int, bands: int, rows: int):
    """Row, text -> row, hash of its set of shingles, size of the set, buckets, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        rng = np.random.default_rng(SEED)
        draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
        flip, times, fold, mark = draw(bands * rows)[:, None], draw(bands * rows)[:, None] | np.uint64(1), draw(bands * rows) | np.uint64(1), draw(bands)
        draws = draw(BITS // 64)
        for batch in batches:
            nodes, sizes, buckets, prints = [], [], [], []
            for text in batch.column("text"):
                h = np.unique(np.array(_hashes(text.as_py(), words, SEED), np.uint64))
                nodes.append(xxh64_intdigest(h.tobytes(), SEED))
                sizes.append(len(h))
                prints.append(wide_print(h, draws))
                if not len(h):
                    buckets.append([])
                    continue
                least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(h), AT_ONCE):
                    np.minimum(least, ((h[at : at + AT_ONCE] ^ flip) * times).min(1), out=least)
                buckets.append(((least * fold).reshape(bands, rows).sum(1, dtype=np.uint64) ^ mark).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(buckets, pa.list_(pa.int64())), pa.array(prints, pa.binary())],
                names=["row", "node", "size", "buckets", "fp"],
            )

    return run


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> list[tuple[int, int]]:
    """Of sets (distinct hashes in order): a spanning forest of the similar pairs within ``left``, or between it and ``right``.

    The pairs are numbers of ``left``, in the second case of ``left + right``. An index of the
    shingles of ``left`` gives the size of a set's intersection with each of its sets.
    """
    sizes = np.array([len(x) for x in left], np.int64)
    values, place = np.unique(np.concatenate(left), return_inverse=True)
    order = np.argsort(place, kind="stable")
    holder = np.repeat(np.arange(len(left)), sizes)[order]
    starts = np.searchsorted(place[order], np.arange(len(values) + 1))
    up = list(range(len(left) + len(right or [])))
    made: list[tuple[int, int]] = []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, own in enumerate(left if right is None else right):
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        at = at[values[at] == own]
        counts = starts[at + 1] - starts[at]
        which = np.repeat(starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        both = np.bincount(holder[which], minlength=len(left))
        near = both >= similarity * (sizes + len(own) - both) - 1e-9
        mine = i if right is None else len(left) + i
        if right is None:
            near[i:] = False
        for j in np.flatnonzero(near).tolist():
            if (a := top(mine)) != (b := top(j)):
                up[a] = b
                made.append((mine, j))
    return made


def _verifier(words: int, similarity: float):
    """Sorted rows (cluster, part, other, own, node, text) -> a forest of the similar pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, groups in sorted_groups(batches, ("cluster", "part", "other")):
            found: list[tuple[int, int]] = []
            for i, j in groups:
                sets = [np.unique(np.array(_hashes(t, words, SEED), np.uint64)) for t in columns["text"][i:j]]
                nodes, own = columns["node"][i:j].tolist(), columns["own"][i:j]
                if columns["part"][i] == columns["other"][i]:
                    pairs = similar(sets, None, similarity)
                else:
                    one, two = np.flatnonzero(own == columns["part"][i]).tolist(), np.flatnonzero(own != columns["part"][i]).tolist()
                    pairs = similar([sets[k] for k in one], [sets[k] for k in two], similarity) if one and two else []
                    nodes = [nodes[k] for k in one + two]
                found += [(nodes[x], nodes[y]) for x, y in pairs]
            if found:
                made = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

    return run


def _maybe(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: false only where ``key`` is none of ``keys(hash)``. The bitmap is broadcast, ``rows`` stay where they are."""
    bits, n = LEAST_BITS, keys.count()
    while bits < min(MAX_BITS, BITS_PER_ROW * n):
        bits *= 2
    slot = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = keys.groupBy(F.shiftright(slot, 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("_mask"))
    at = fresh(rows, "slot")
    out = rows.withColumn(at, key.bitwiseAND(F.lit(bits - 1))).join(F.broadcast(words), F.shiftright(F.col(at), 6) == F.col("_word"), "left")
    hit = F.coalesce(F.expr(f"(shiftright(_mask, cast(`{at}` & 63 as int)) & 1) = 1"), F.lit(False))
    return out.withColumn(name, hit).drop("_word", "_mask", at)


def _texts(marked: DataFrame, row: str, text_col: str, needed: DataFrame) -> DataFrame:
    """``needed(node, least, ...)`` with the text of the row ``least``. Only texts that may be needed are shuffled."""
    near = _maybe(marked.select(row, F.col(text_col).alias("text")), F.col(f"{row}.hash"), needed.select("least.hash"), "_some").where("_some")
    return near.join(needed, F.col(row) == F.col("least")).dropDuplicates(["node"]).drop(row, "least", "_some")


def drop_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, part: int = PART
) -> DataFrame:
    """The documents, one of each component of near copies (that of the smallest id), with their columns.

    Texts without a word, nulls among them, are copies of each other; shorter ones than a shingle are
    one shingle, long ones count with all their shingles. Rows of a component that share the smallest
    id are told apart by a hash of all their columns, so of repeated rows exactly one is left; a null
    id is smaller than any other. Equal sets of shingles are found by their 64-bit hash. Rows without
    a near copy are not shuffled, but for a few that share a slot of the bitmap. An empty table gives
    an empty result, columns may have any names. ``BITS`` and ``RADIUS`` hold for a similarity of 0.8
    or more.
    """
    row = fresh(docs, "row")
    marked = small_batches(docs).withColumn(row, F.struct(F.col(id_col).alias("id"), F.xxhash64(*docs.columns).alias("hash")))
    kind = marked.schema[row].dataType.simpleString()
    signed = marked.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    prints = checkpoint(signed.mapInArrow(trimmed(_signer(words, bands, rows)), f"row {kind}, node long, size int, buckets array<long>, fp binary"))
    n = prints.count()
    groups = checkpoint(prints.groupBy("node").agg(F.min("row").alias("least"), F.first("size").alias("size"), F.count(F.lit(1)).alias("group_size")))
    keyed = prints.where(F.size("buckets") > 0).select("node", F.explode("buckets").alias("bucket"))
    shared = checkpoint(keyed.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("group_size")).where("first <> last").select("bucket", "group_size"))
    members = checkpoint(join_counted(keyed, shared, "bucket", n * bands).select(F.col("bucket").alias("shard"), "node").distinct())
    wide = prints.join(members.select("node").distinct(), "node", "left_semi").select("node", "fp").dropDuplicates(["node"])
    candidates = components(link_shards(members.join(wide, "node"), RADIUS))
    needed = checkpoint(groups.join(candidates.withColumnRenamed("root", "cluster"), "node").select("node", "least", "cluster", "size"))
    large = checkpoint(needed.groupBy("cluster").agg(F.ceil(F.sum("size") / part).cast("int").alias("parts")).where("parts > 1"))
    texts = checkpoint(_texts(marked, row, text_col, needed.drop("size")))
    pairs = dealt_in_parts(texts, "cluster", large).select("cluster", "part", "other", "own", "node", "text")
    roots = components(checkpoint(pairs.mapInArrow(trimmed(_verifier(words, similarity)), "a long, b long")))
    rooted = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("kept"), F.sum("group_size").alias("rows"), F.count(F.lit(1)).alias("nodes")).where("rows > 1")
    several = checkpoint(join_counted(rooted, whole, "root", n, size="nodes").select("node", "group_size", "kept"))
    found = checkpoint(join_counted(prints.select("row", "node"), several, "node", n).select("row", "kept"))
    told = _maybe(marked, F.col(f"{row}.hash"), found.select("row.hash"), maybe := fresh(marked, "maybe"))
    alone = told.where(~F.col(maybe)).select(docs.columns)
    dropped = found.where("row <> kept").select(F.col("row").alias("_dropped")).distinct()
    left = told.where(maybe).dropDuplicates([row]).join(dropped, F.col(row) == F.col("_dropped"), "left_anti").select(docs.columns)
    return alone.unionByName(left)
