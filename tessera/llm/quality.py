"""Quality by compression: dictionaries of good and of bad text, and how much better one fits.

Two zstandard dictionaries are built from labelled text of either class, in two views of a text: its
bytes, and its shape (letters by case, digits, the rest as it is), which no language dominates. A
text is compressed in chunks with either dictionary and with none; ``(bad - good) / none`` is the
normalised difference of a view. A logistic model, fitted on labelled rows that the dictionaries have
not seen, turns the two differences and the compression ratio of the whole text into a calibrated
probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold_of, small_batches, table, trim
from tessera.llm.learn import Logistic, labelled_sample

DICTIONARY_BYTES, CHUNK, LEVEL, THRESHOLD = 32_768, 1000, 3, 0.3
#: The shape of each byte: a for small and non-ASCII letters, A for capitals, 9 for digits.
SHAPE = bytes(
    ord("a") if 97 <= i <= 122 or i >= 128 else ord("A") if 65 <= i <= 90 else ord("9") if 48 <= i <= 57 else i for i in range(256)
)


def _chunks(b: bytes) -> list[bytes]:
    return [b[i : i + CHUNK] for i in range(0, len(b), CHUNK)]


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard

    parts = [c for t in texts for c in _chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(parts)[-DICTIONARY_BYTES:]


class Compressors:
    """The features of a text by the dictionaries ``[(good, bad) of each view]``."""

    def __init__(self, dictionaries: list[tuple[bytes, bytes]]):
        import zstandard

        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.views = [[zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in pair] for pair in dictionaries]
        self.none = zstandard.ZstdCompressor(LEVEL, **plain)

    def __call__(self, text: bytes) -> list[float]:
        out: list[float] = []
        for view, (good, bad) in zip((text, text.translate(SHAPE)), self.views, strict=True):
            parts = _chunks(view)
            g, b, n = (sum(len(c.compress(p)) for p in parts) for c in (good, bad, self.none))
            out.append((b - g) / max(n, 1))
        ratio = len(self.none.compress(text)) / (len(text) + 30)
        return [*out, ratio, np.log(ratio + 0.01), np.log(len(text) + 1)]


def train(texts: list[str], y: np.ndarray, weight: np.ndarray):
    """(dictionaries, model); the model is the share of label 1 where a class is missing."""
    raw = [t.encode() for t in texts]
    fit, rest = np.arange(len(y)) % 2 == 0, np.arange(len(y)) % 2 == 1
    if any((y[part] == c).sum() < 2 for part in (fit, rest) for c in (0, 1)):
        return None, float((weight * y).sum() / max(weight.sum(), 1e-9)) if len(y) else 0.5
    dictionaries = [
        tuple(_dictionary([view(raw[i]) for i in np.flatnonzero(fit & (y == c))]) for c in (1, 0))
        for view in (lambda b: b, lambda b: b.translate(SHAPE))
    ]
    of = Compressors(dictionaries)
    x = np.array([of(raw[i]) for i in np.flatnonzero(rest)])
    return dictionaries, Logistic(x, y[rest], weight[rest])


def _scorer(dictionaries, model):
    """The score of each text. Only texts go to Python, and the scores come back."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Compressors(dictionaries) if dictionaries else None
        for texts in batches:
            if of is None:
                yield pa.array(np.full(len(texts), model), pa.float64())
            else:
                found = [of((t.as_py() or "").encode()) for t in texts]
                yield pa.array(model(np.array(found).reshape(len(texts), -1)), pa.float64())
        trim()

    return score


def score_quality(docs: DataFrame, labels: DataFrame, held_out: int = 0) -> DataFrame:
    """``doc_id, held_out, score`` of every row: the probability that its label is 1.

    Null and empty texts are scored like any text (as empty), long ones as a whole, repeated rows get
    equal scores; other columns are ignored, whatever their names; an empty table gives an empty
    result. With no labels of one of the classes the score is the share of label 1 (0.5 without any
    label).
    """
    score = _scorer(*train(*labelled_sample(docs, labels, "quality", held_out)[:3]))
    trim()
    return small_batches(docs).select(F.col("doc_id"), (fold_of(F.col("doc_id")) == held_out).alias("held_out"), score(F.col("text")).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with the columns of ``docs``. Edge cases as in ``score_quality``."""
    score = _scorer(*train(*labelled_sample(docs, labels, "quality")[:3]))
    trim()
    return small_batches(docs).where(score(F.col("text")) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op7``: every row of ``documents``."""
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
