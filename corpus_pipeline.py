"""A corpus pipeline of five stages: quality, exact and near duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and returns the
columns of ``documents``, but for the last, which returns the packed pieces.

In every stage other columns pass unchanged, whatever their names, a null text counts as empty, long
texts count as a whole and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, table
from tessera.llm.exact_dedup import drop_exact
from tessera.llm.mixing import mix
from tessera.llm.packing import pack
from tessera.llm.quality import keep_good
from tessera.llm.simhash import drop_near


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts (score of 0.3 or more).

    Repeated rows and ties have equal scores, so all or none of them stay; empty texts are scored too.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each distinct text, that of the largest id.

    Null and empty texts are one text, a null id is the smallest; of repeated rows one stays.
    """
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Near copies have a Jaccard similarity of 0.8 or more over five-word shingles. Texts without a word
    are one group, shorter ones than a shingle are one shingle; of repeated rows one stays.
    """
    return drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it.

    A null source is a source of its own; rows that share an id share their draw.
    """
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    An empty text is one piece of one token; every copy of a row is packed for itself.
    """
    return pack(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: Trained and iterative stages: SQL cannot express the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
