"""Blocks and buckets: ask the whole corpus about what a block of documents holds, without moving it twice.

Documents are dealt to blocks of a few megabytes by a hash of their id. A block sends, for each bucket
of a key space, one row with compact arrays; a bucket gathers these rows from all blocks, works on
its part of the key space and answers each block; a block then reads its answers beside its texts.
Both steps over the texts use the same exchange of the documents, which Spark reuses.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLOCK_BYTES, block_count, small_batches, text_bytes

#: Text bytes whose keys one bucket gathers on average.
BUCKET_BYTES = 16_000_000


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(``block, row, doc_id, text``, number of buckets). ``row`` orders the rows of a block.

    Null texts become empty. Rows that share an id and a text share ``row``, in which case either
    may come first: they are equal.
    """
    n = text_bytes(docs, text_col)
    blocks, buckets = block_count(n, 12, BLOCK_BYTES), block_count(n, 12, BUCKET_BYTES)
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select(F.pmod(F.xxhash64(F.lit(6), "doc_id", F.octet_length("text")), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text"), buckets


def pack_sorted(keys: np.ndarray) -> bytes:
    """Unsigned 64-bit integers in rising order: differences, byte by byte, compressed."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.cumsum(planes.reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Counts, one byte each but for those of 255 and more, which follow."""
    large = values >= 255
    return zlib.compress(np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype("<u8").tobytes(), 1)


def unpack_small(raw: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(raw)
    values = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    values[values == 255] = np.frombuffer(data[n:], "<u8").astype(np.int64)
    return values
