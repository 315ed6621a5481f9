"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one block of documents (one Python call) holds on average.
BLOCK_BYTES = 6_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs nothing.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset, and only on one
    machine, a temporary folder is used. Its files go with ``df`` where the session is set to clean
    checkpoints (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch where the session has Spark's own default of 64 MB.
BATCH_BYTES = 8_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends batches of about ``BATCH_BYTES`` to Python workers.

    A batch is held on both sides, several times over while it is built. A session that has set
    another size than the default keeps it.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) in ("67108864b", "67108864", "64MB", "64m"):
        conf.set(name, str(BATCH_BYTES))
    return df


def release(spark: SparkSession) -> None:
    """Lets the driver give up what earlier steps left: plans, generated classes, and with them shuffles and checkpoints.

    Spark drops these when the driver's JVM has collected what refers to them, which a loop of many small plans
    does not bring about before its memory is full.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives memory that a worker has freed back to the system; a worker is kept from task to task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def trimmed(run):
    """``run(batches)`` that trims the worker when a task is over."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return out


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one narrow scan, nothing is shuffled but one number a task."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first()["n"])


def block_count(n_bytes: int, least: int = 12, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of documents to deal, in proportion to the text."""
    return max(least, -(-n_bytes // block_bytes))


def word_count(text: Column) -> Column:
    """Number of words (``WORD``) of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: the held-out fold of the learning contracts."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")

#: A key above this part of all rows is heavy; so there are fewer than HEAVY heavy keys.
HEAVY = 500


def join_counted(rows: DataFrame, groups: DataFrame, key: str, n_rows: int, size: str = "group_size") -> DataFrame:
    """``rows`` joined to ``groups`` (one row a key, ``size`` counts its rows) without a hot task.

    Keys with more than ``n_rows / HEAVY`` rows are fewer than ``HEAVY``: they are joined by
    broadcast. What is left has no large key and is joined by a shuffle.
    """
    bound = max(1, n_rows // HEAVY)
    heavy, light = groups.where(F.col(size) > bound), groups.where(F.col(size) <= bound)
    some = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light.hint("shuffle_hash"), key)
    return some.unionByName(rest)
