"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 hashes every text to two slots of a bitmap of fixed size and counts rows a slot; a slot that
two rows hit is marked. The marked slots are kept as 64-bit words and broadcast: at most
``max_bits / 64`` words, whatever the input. Pass 2 sends a row on to the grouping shuffle only if
both of its slots are marked; every other row is unique for certain and passes straight through. A
full bitmap costs shuffling, never a wrong result.

Groups are aggregated before they are shuffled. Groups that hold more than 1/500 of the
rows are joined by broadcast (there are fewer than 500 of them), the rest by a shuffle, so a
text that makes up a third of the corpus does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, join_counted, table

#: Bits of the bitmap: 16 a row, but no more than 2**27 (16 MB as words).
BITS_PER_ROW, LEAST_BITS, MAX_BITS = 16, 1 << 16, 1 << 27


def _slots(key):
    """Two slot numbers before reduction, from independent parts of the digest (hex)."""
    return [F.conv(F.substring(key, at, 12), 16, 10).cast("long") for at in (1, 21)]


def marked_slots(digests: DataFrame, key: str = "text_sha256", max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """(``word, mask`` of the slots that two rows hit, bits of the bitmap): at most ``max_bits / 64`` rows."""
    n = digests.count()
    bits = LEAST_BITS
    while bits < min(max_bits, BITS_PER_ROW * n):
        bits *= 2
    slots = F.array_distinct(F.array(*[F.pmod(s, F.lit(bits)) for s in _slots(F.col(key))]))
    hits = digests.select(F.explode(slots).alias("slot")).groupBy("slot").count()
    words = (
        hits.where("count > 1")
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask"))
    )
    return words, bits


def possibly_repeated(rows: DataFrame, words: DataFrame, bits: int, key: str = "text_sha256") -> DataFrame:
    """Adds ``maybe``: false only where no other row has the same key. The bitmap is broadcast, the rows stay where they are."""
    out = rows
    for i, s in enumerate(_slots(F.col(key))):
        w = words.select(F.col("word").alias(f"_w{i}"), F.col("mask").alias(f"_m{i}"))
        out = out.withColumn(f"_s{i}", F.pmod(s, F.lit(bits))).join(F.broadcast(w), F.shiftright(F.col(f"_s{i}"), 6) == F.col(f"_w{i}"), "left")
    set_ = [F.coalesce(F.expr(f"(shiftright(_m{i}, cast(_s{i} & 63 as int)) & 1) = 1"), F.lit(False)) for i in range(2)]
    return out.withColumn("maybe", set_[0] & set_[1]).drop(*[f"_{c}{i}" for c in "swm" for i in range(2)])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as the empty text, so null and empty texts form one
    group. The row with the largest id stays. A null id is smaller than any other; rows that share
    both text and the largest id (repeated rows) are all marked as kept. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    digests = checkpoint(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_sha256"),
        )
    )
    tested = possibly_repeated(digests, *marked_slots(digests, max_bits=max_bits))
    alone = tested.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    rows = tested.where("maybe").select("doc_id", "text_sha256")
    groups = checkpoint(rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    joined = join_counted(rows, groups, "text_sha256", digests.count()).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(joined)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The documents, one row for each distinct text (of the largest id), with all their columns.

    Only digests go to the bitmap; it is then broadcast and tested on the documents themselves, so
    rows that it shows to be alone are never shuffled. The others are reduced by ``max_by`` before
    and after the shuffle, so of repeated rows exactly one is left and a hot text sends one row a
    task. Null and empty texts are one group; columns may have any names.
    """
    clash = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    hashed = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_sha256")
    flat = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in clash.items()], hashed)
    words, bits = marked_slots(checkpoint(flat.select("text_sha256")), max_bits=max_bits)
    tested = possibly_repeated(flat, checkpoint(words), bits)
    order = F.struct(F.col(clash[id_col]), F.xxhash64(*clash.values()))
    some = (
        tested.where("maybe")
        .groupBy("text_sha256")
        .agg(F.max_by(F.struct(*clash.values()), order).alias("packed"))
        .select("packed.*")
    )
    return tested.where(~F.col("maybe")).select(*clash.values()).unionByName(some).select(*[F.col(a).alias(c) for c, a in clash.items()])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op9``: every row of ``documents``."""
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
