"""SimHash near-duplicates with BK-trees.

Fingerprints are made in one narrow pass. Equal ones are put together, and the distinct ones are
linked: two that differ in at most ``radius`` bits agree on ``agree`` of ``agree + radius`` blocks of
bits, so each is sent to one shard for every choice of ``agree`` blocks. A shard's key is the first
bits of these blocks, as many as give shards of about ``MEAN`` fingerprints at any size of the corpus.
A shard builds a BK-tree (children keyed by their integer distance to the parent) and asks it for
each fingerprint, following only edges within the radius. A tree reaches only the queries of its own
shard: the trees of a whole corpus have no bound and are not broadcast. A shard that holds more than
``SHARD`` fingerprints is split into parts, and each pair of parts is a task of its own, so none grows
with the largest group. What leaves a shard is a spanning forest of its links, at most one row a
fingerprint, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, join_counted, small_batches, table, trimmed
from tessera.llm.components import components

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints that a shard has on average, and those of a part where a larger one is split. Up to so many split shards are joined by broadcast.
MEAN, SHARD, BROADCAST_SHARDS = 512, 2048, 100_000
#: Hashes whose bits are counted at once.
AT_ONCE = 1 << 17


def shingles(text: str | None, words: int = WORDS) -> list[bytes]:
    """The word shingles of a text, A-Z in lower case; a shorter text is one shingle, none gives none."""
    w = (text or "").encode().lower().split()
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]


def _hashes(text: str | None, words: int, seed: int) -> list[int]:
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if len(w) <= words:
        return [xxh64_intdigest(b" ".join(w), seed)] if w else []
    whole = b" ".join(w)
    ends = list(itertools.accumulate(map(len, w), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [xxh64_intdigest(whole[i:j], seed) for i, j in zip(starts, ends[words - 1 :], strict=False)]


def fingerprints_of(texts: list[str | None], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text: a bit is set if it is set in over half the hashes."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, t in enumerate(texts):
        h = np.array(_hashes(t, words, seed), "<u8")
        count = np.zeros(64, np.int64)
        for at in range(0, len(h), AT_ONCE):
            bits = np.unpackbits(h[at : at + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += bits.sum(0, dtype=np.int64)
        out[i] = weights[2 * count > len(h)].sum(dtype=np.uint64) if len(h) else 0
    return out


class BKTree:
    """Fingerprints under a root; a child hangs at its distance to the parent."""

    def __init__(self):
        self.root = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while d := (x ^ node[0]).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (x, {})
                return
            node = child

    def near(self, x: int, radius: int) -> Iterator[int]:
        """What lies within the radius of ``x``: by the triangle inequality only edges of d +- radius can lead there."""
        stack = [self.root] if self.root else []
        while stack:
            y, children = stack.pop()
            d = (x ^ y).bit_count()
            if d <= radius:
                yield y
            if children:
                stack += [c for e, c in children.items() if d - radius <= e <= d + radius]


def forest(left: list[tuple[int, int]], right: list[tuple[int, int]] | None, radius: int) -> list[tuple[int, int]]:
    """Of nodes with fingerprints ``(node, x)``: a spanning forest of the links within ``left``, or between it and ``right``."""
    up: dict[int, int] = {}
    made: list[tuple[int, int]] = []
    tree, holder = BKTree(), {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(x: int, y: int) -> None:
        if (a := top(x)) != (b := top(y)):
            up[a] = b
            made.append((x, y))

    def put(node: int, x: int) -> None:
        holder[x] = node
        tree.add(x)

    for node, x in left if right is not None else []:
        if x in holder:
            link(node, holder[x])
        else:
            put(node, x)
    for node, x in left if right is None else right:
        if x in holder:  # all that is near an equal fingerprint is linked to it
            link(node, holder[x])
        if right is not None or x not in holder:
            for y in tree.near(x, radius):
                link(node, holder[y])
        if right is None and x not in holder:
            put(node, x)
    return made


def _linker(radius: int):
    """Sorted rows (shard, part, other, own, node, fp) -> links (a, b) of nodes; groups may span batches."""

    def flush(part: int, other: int, own: np.ndarray, node: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        values = [int.from_bytes(x, "little") for x in fp] if fp.dtype == object else fp.astype(np.uint64).tolist()
        pairs, own = list(zip(node.tolist(), values, strict=True)), own.tolist()
        if part == other:
            return forest(pairs, None, radius)
        return forest([p for p, o in zip(pairs, own, strict=True) if o == part], [p for p, o in zip(pairs, own, strict=True) if o == other], radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, groups in sorted_groups(batches, ("shard", "part", "other")):
            found: list[tuple[int, int]] = []
            for i, j in groups:
                if j - i > 1:
                    found += flush(columns["part"][i], columns["other"][i], *(columns[c][i:j] for c in ("own", "node", "fp")))
            if found:
                pairs = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def sorted_groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[dict[str, np.ndarray], list[tuple[int, int]]]]:
    """Batches of rows sorted by ``key`` -> columns, and where each group ends that is whole by then."""
    kept: dict[str, np.ndarray] = {}
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            new = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            kept = {n: np.concatenate([kept[n], x]) for n, x in new.items()} if kept else new
        if not kept or not len(kept[key[0]]):
            continue
        edge = np.flatnonzero(np.logical_or.reduce([np.diff(kept[k]) != 0 for k in key])) + 1
        edges = [0, *edge.tolist(), len(kept[key[0]])]
        if batch is not None:  # the last group may go on
            edges.pop()
        yield kept, list(itertools.pairwise(edges))
        kept = {n: x[edges[-1] :] for n, x in kept.items()}


def dealt_in_parts(keyed: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """``keyed`` sorted by ``key, part, other``: a group of k ``parts`` (``key, parts``) comes as each pair of its parts.

    ``own`` says to which of the two a row belongs. Groups that ``parts`` leaves out have one part.
    """
    if parts.count() <= BROADCAST_SHARDS:
        parts = F.broadcast(parts)
    several = F.coalesce("parts", F.lit(1))
    dealt = keyed.join(parts, key, "left").withColumn("own", F.pmod(F.xxhash64(F.lit("part"), "node"), several).cast("int"))
    spread = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), several - 1)))
    rows = spread.withColumns({"part": F.least("own", "_with"), "other": F.greatest("own", "_with")}).drop("_with", "parts")
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key, "part", "other").sortWithinPartitions(key, "part", "other")


def link_shards(keyed: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """``shard, node, fp`` (long, or little-endian binary) -> links ``a, b`` that connect whatever lies within the radius in a shard."""
    large = checkpoint(keyed.groupBy("shard").count().where(F.col("count") > shard))
    rows = dealt_in_parts(keyed, "shard", large.select("shard", F.ceil(F.col("count") / shard).cast("int").alias("parts")))
    return rows.select("shard", "part", "other", "own", "node", "fp").mapInArrow(trimmed(_linker(radius)), "a long, b long").distinct()


def _shards(fp, radius: int, n: int, mean: int):
    """Keys of the shards of a fingerprint: which blocks, and their first bits."""
    wanted = max(0, (n // mean).bit_length() - 1)
    agree = 1
    while agree * (64 // (agree + radius)) < wanted and agree + radius < 32:
        agree += 1
    blocks, bits = agree + radius, min(-(-wanted // agree), 64 // (agree + radius))
    lows = [i * 64 // blocks for i in range(blocks)]
    keys = []
    for c, chosen in enumerate(itertools.combinations(lows, agree)):
        mask = sum(((1 << bits) - 1) << low for low in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(c), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def links(distinct: DataFrame, n: int | None = None, radius: int = RADIUS, mean: int = MEAN, shard: int = SHARD) -> DataFrame:
    """``fp`` (``n`` distinct longs) -> links ``a, b`` that connect whatever lies within the radius.

    Shard keys are hashed; a collision only adds candidates, for every link is made by its distance.
    """
    keys = _shards(F.col("fp"), radius, distinct.count() if n is None else n, mean)
    keyed = distinct.select(F.col("fp").alias("node"), "fp", F.explode(keys).alias("shard"))
    return link_shards(keyed, radius, shard)


def _printer(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints_of(batch.column("text").to_pylist(), words, seed)
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(prints.view(np.int64))], names=[*names, "fp"])

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row per input row: ``doc_id, fp`` (signed long), ``component_id`` (smallest id reachable).

    Null and empty texts, and texts of white space alone, have fingerprint zero and are linked like
    any other. Texts shorter than a shingle are hashed whole. Repeated rows share a component; null
    ids are ignored where the smallest id is taken. Other columns are ignored, an empty table gives
    an empty result.
    """
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = checkpoint(rows.mapInArrow(trimmed(_printer(words, seed)), f"doc_id {kind}, fp long"))
    groups = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("group_size")))
    distinct = groups.count()
    roots = components(links(groups.select("fp"), distinct, radius))
    rooted = groups.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    labelled = checkpoint(join_counted(rooted, least, "root", distinct, size="prints").select("fp", "group_size", "component_id"))
    return join_counted(prints, labelled, "fp", prints.count()).select("doc_id", "fp", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, one of each group of near copies: five-word shingles, similarity 0.8 (see ``llm.jaccard``).

    Fingerprints of 256 bits and BK-trees give the candidates, the exact similarity of their texts
    decides. Nulls, empty and long texts, repeated rows and clashing names: see ``drop_similar``.
    """
    from tessera.llm.jaccard import drop_similar

    return drop_similar(docs, id_col, text_col, **options)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op2``: every row of ``documents``."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
