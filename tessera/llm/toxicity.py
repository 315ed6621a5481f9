"""Toxicity by a small convolutional network over hashed words, trained in numpy.

A word is the sum of hashed embeddings: itself under two hashes and its first 4, 5 and 6 letters, so
inflected forms share their stem. Filters of widths 1, 2 and 3 run over the words, the largest value
of each filter goes to a logistic unit. What training never saw has a zero embedding, so a long text
gains nothing from unknown words. The score sees the text alone. For the operator's own flags, a
threshold per language is chosen on every labelled training row that a second network was not fitted
on: that network learns from four fifths of the sample, so all other labels have a part in the
thresholds, however many they are. No row of the held-out fold has one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, fold_of, small_batches, table, trim
from tessera.llm.learn import Sample, clear_labels, labelled_sample

BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED = 4, 24, 0.1, 7
#: Scoring takes so many words at once.
SCORE_WORDS = 400_000
EDGE = b".,;:!?$%*&#|\"'()[]{}<>-_~`=+/\\"
#: Bytes of the stems, and what stands between two texts.
STEMS, GAP = (4, 5, 6), (0,) * max(WIDTHS)
#: Steps of the scores between which thresholds are sought; rows of one step stay on one side.
STEPS = 1 << 16
#: Thresholds of at most so many languages are joined by broadcast.
MOST_GROUPS = 100_000
#: A worker remembers so many words.
REMEMBERED = 250_000


def buckets(word: bytes) -> tuple[int, ...]:
    """The five buckets of a word, the last three of its stem (bucket 0 stands for nothing)."""
    if not word.isascii():
        word = word.decode("utf-8", "replace").lower().encode()
    w = word.strip(EDGE)
    if not w:
        return (0,) * 5
    stems = [1 + zlib.crc32(w[:k], k) % (BUCKETS - 1) if len(w) >= k else 0 for k in STEMS]
    return (1 + zlib.crc32(w, 1) % (BUCKETS - 1), 1 + zlib.crc32(w, 2) % (BUCKETS - 1), *stems)


class Words(dict):
    """Words of texts as numbers, and the buckets of each number; number 0 is the gap between texts."""

    def __init__(self):
        super().__init__({b"": 0})
        self.found: list[tuple[int, ...]] = [(0,) * 5]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.found.append(buckets(word))
        return n

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words with gaps after each text, where each text starts)."""
        out: list[int] = []
        starts = []
        for t in texts:
            starts.append(len(out))
            out.extend(map(self.__getitem__, t.encode().lower().split()))
            out.extend(GAP)
        return np.array(out, np.int64), np.array(starts, np.int64)

    def buckets(self, start: int = 0) -> np.ndarray:
        return np.array(self.found[start:], np.int64).reshape(-1, 5)


def _pool(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The largest value of each filter from a start to before its stop, but no less than 0."""
    edges = np.stack([starts, stops], 1).ravel()
    return np.maximum(np.maximum.reduceat(values, edges[edges < len(values)], axis=0)[::2], 0)


def _stops(starts: np.ndarray, size: int) -> np.ndarray:
    """Where the windows end that lie within a text and the gap after it: none reaches the next text."""
    return np.append(starts[1:], size) - len(GAP) + 1


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
        self.table[0] = 0
        self.conv = [rng.normal(0, 0.4, (k, SIZE, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = 0.0

    def pooled(self, numbers: np.ndarray, starts: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest filter values of each text, and the filter values at each word."""
        maxima, values, stops = [], [], _stops(starts, len(numbers))
        for k, w in zip(WIDTHS, self.conv, strict=True):
            n = len(numbers) - k + 1
            v = (vectors @ w[0])[numbers[:n]]
            for j in range(1, k):
                v += (vectors @ w[j])[numbers[j : j + n]]
            values.append(v)
            maxima.append(_pool(v, starts, stops))
        return np.concatenate(maxima, axis=1), values

    def vectors(self, found: np.ndarray) -> np.ndarray:
        return self.table[found].sum(1)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of some texts; what a filter makes of a word is remembered from call to call."""
        if not texts:
            return np.zeros(0)
        if not hasattr(self, "words") or len(self.words) > REMEMBERED:
            self.words, self.made = Words(), [[np.zeros((0, FILTERS), np.float32)] * k for k in WIDTHS]
        numbers, starts = self.words(texts)
        known = len(self.made[0][0])
        new = self.vectors(self.words.buckets(known))
        top = []
        for made, k, w in zip(self.made, WIDTHS, self.conv, strict=True):
            made[:] = [np.concatenate([m, new @ w[j]]) for j, m in enumerate(made)]
            n = len(numbers) - k + 1
            v = np.take(made[0], numbers[:n], axis=0)
            for j in range(1, k):
                v += np.take(made[j], numbers[j : j + n], axis=0)
            top.append(_pool(v, starts, _stops(starts, len(numbers))))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(top, axis=1) @ self.out + self.bias, -40, 40).astype(np.float64)))

    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray) -> None:
        """Adagrad on the weighted logistic loss; only touched rows of the table change."""
        rng, words = np.random.default_rng(SEED), Words()
        coded = [words([t])[0] for t in texts]
        found = words.buckets()
        seen = np.zeros(BUCKETS, bool)
        seen[found] = True
        self.table[~seen] = 0
        grown = np.full((BUCKETS, SIZE), 1e-6, np.float32)
        sums = [np.full_like(w, 1e-6) for w in self.conv]
        sum_out, sum_bias = np.full_like(self.out, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                lens = [len(coded[i]) for i in part]
                starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                own, numbers = np.unique(np.concatenate([coded[i] for i in part]), return_inverse=True)
                vectors = self.vectors(found[own])
                top, values = self.pooled(numbers, starts, vectors)
                p = 1 / (1 + np.exp(-np.clip(top @ self.out + self.bias, -40, 40)))
                g = (weight[part] * (p - y[part])).astype(np.float32)
                d_top = g[:, None] * self.out * (top > 0)
                d_vec = np.zeros_like(vectors)
                for i, (k, w) in enumerate(zip(WIDTHS, self.conv, strict=True)):
                    d = d_top[:, i * FILTERS : (i + 1) * FILTERS]
                    ends = _stops(starts, len(numbers))
                    best = np.array([s + values[i][s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])
                    d_w = np.empty_like(w)
                    for j in range(k):
                        rows = numbers[best + j]
                        d_w[j] = np.einsum("bf,bfd->df", d, vectors[rows])
                        np.add.at(d_vec, rows, d[:, :, None] * w[j].T[None])
                    sums[i] += d_w * d_w
                    w -= RATE * 0.3 * d_w / np.sqrt(sums[i])
                hit = np.flatnonzero(np.abs(d_vec).sum(1))
                at_rows = found[own[hit]].ravel()
                d_rows = np.repeat(d_vec[hit], found.shape[1], axis=0)
                some, where = np.unique(at_rows, return_inverse=True)
                d_some = np.zeros((len(some), SIZE), np.float32)
                np.add.at(d_some, where, d_rows)
                grown[some] += d_some * d_some
                self.table[some] -= RATE * d_some / np.sqrt(grown[some])
                self.table[0] = 0
                d_out, d_bias = top.T @ g, float(g.sum())
                sum_out += d_out * d_out
                sum_bias += d_bias * d_bias
                self.out -= RATE * 0.3 * d_out / np.sqrt(sum_out)
                self.bias -= RATE * 0.3 * d_bias / np.sqrt(sum_bias)


def train(texts: list[str], y: np.ndarray, weight: np.ndarray) -> Network | float:
    """A network, or the share of label 1 where a class has no row."""
    if not len(y) or (y == 0).all() or (y == 1).all():
        return float(y.mean()) if len(y) else 0.0
    net = Network()
    net.fit(texts, y, weight)
    return net


def _scores(net: Network | float, texts: list[str]) -> np.ndarray:
    """Scores of some texts, a bounded number of words at a time."""
    out, at, size = [np.zeros(0)], 0, 0
    for i, t in enumerate(texts):
        size += len(t) // 5
        if size >= SCORE_WORDS or i == len(texts) - 1:
            part = texts[at : i + 1]
            out.append(np.full(len(part), net) if isinstance(net, float) else net.scores(part))
            at, size = i + 1, 0
    return np.concatenate(out)


def _scorer(net: Network | float):
    """The score of each text. Only texts go to Python, and the scores come back."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(_scores(net, [t or "" for t in texts.to_pylist()]), pa.float64())
        trim()

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 0) -> DataFrame:
    """``doc_id, held_out, score`` of every row: how likely its label is 1.

    Null texts are scored as empty ones, long ones as a whole, repeated rows get equal scores; other
    columns are ignored, whatever their names; an empty table gives an empty result. Without labels
    of both classes the score is the share of label 1 (0 without any label).
    """
    score = _scorer(train(*labelled_sample(docs, labels, "toxic", held_out)[:3]))
    return small_batches(docs).select("doc_id", (fold_of(F.col("doc_id")) == held_out).alias("held_out"), score(F.col("text")).alias("score"))


def best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the largest weighted F1, between two scores; 0.5 where a class is missing."""
    if not (y == 1).any() or not (y == 0).any():
        return 0.5
    order = np.argsort(-score, kind="stable")
    ranked, w = score[order], weight[order]
    hits, above = np.cumsum(w * y[order]), np.cumsum(w)
    f1 = 2 * hits / (above + hits[-1])
    ends = np.append(ranked[1:] < ranked[:-1], True)  # equal scores stay on one side
    at = int(np.argmax(np.where(ends, f1, -1)))
    below = ranked[at + 1] if at + 1 < len(ranked) else 0.0
    return float((ranked[at] + below) / 2)


def _calibrating(sample: Sample, parts: int = 5) -> tuple[Network | float, list]:
    """(a network, the ids it was fitted on): every fifth row of the sample is left out of it."""
    own = np.arange(len(sample.y)) % parts == 0
    net = train([t for t, o in zip(sample.texts, own, strict=True) if not o], sample.y[~own], sample.weight[~own])
    return net, [i for i, o in zip(sample.ids, own, strict=True) if not o]


def language_thresholds(scored: DataFrame, of: DataFrame, fitted_on: DataFrame) -> DataFrame:
    """``group, threshold``: the best threshold of each group over all labelled rows that the network was not fitted on.

    ``scored(doc_id, lang, other)`` has the network's scores, ``of(doc_id, y)`` the labels, one an id;
    of an id with several rows the one of the lowest score counts. Rows are counted in steps of the
    score first, so a group's table is bounded whatever the number of its labels.
    """
    rows = scored.join(of, "doc_id").join(fitted_on, "doc_id", "left_anti").groupBy("doc_id", "y").agg(F.min(F.struct("other", F.coalesce("lang", F.lit("")).alias("group"))).alias("row"))
    step = F.floor(F.col("row.other") * STEPS).alias("step")
    counts = rows.groupBy("row.group", step).agg(
        F.sum(F.col("y").cast("double")).alias("hits"), F.count(F.lit(1)).cast("double").alias("n"), F.min("row.other").alias("low"), F.max("row.other").alias("high")
    )

    def best(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("step", ascending=False)
        hits, above, found = part["hits"].cumsum().to_numpy(), part["n"].cumsum().to_numpy(), 0.5
        if 0 < hits[-1] < above[-1]:
            at = int(np.argmax(2 * hits / (above + hits[-1])))
            found = float((part["low"].iloc[at] + (part["high"].iloc[at + 1] if at + 1 < len(part) else 0.0)) / 2)
        return pd.DataFrame({"group": [part["group"].iloc[0]], "threshold": [found]})

    return counts.groupBy("group").applyInPandas(best, "group string, threshold double")


def flag_toxic(docs: DataFrame, labels: DataFrame, held_out: int = 0, lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, score, threshold, flagged``: scores, and flags by the threshold of each row's language.

    One row per input row. A language without a label that the thresholds may see, and every row where
    there is no such column, has 0.5. Otherwise as ``score_toxicity``.
    """
    named = lang_col in docs.columns
    sample = labelled_sample(docs, labels, "toxic", held_out)
    named = named and len(sample.y) > 0
    score = _scorer(train(*sample[:3]))
    held = (fold_of(F.col("doc_id")) == held_out).alias("held_out")
    if not named:
        return small_batches(docs).select("doc_id", held, score(F.col("text")).alias("score")).select("*", F.lit(0.5).alias("threshold"), (F.col("score") >= 0.5).alias("flagged"))
    net, ids = _calibrating(sample)
    other = _scorer(net)
    del sample
    trim()
    lang = F.col(lang_col).cast("string")
    # scores are written out once, for the thresholds and for the result; texts are not joined with the labels
    rows = checkpoint(small_batches(docs).select("doc_id", held, score(F.col("text")).alias("score"), other(F.col("text")).alias("other"), F.coalesce(lang, F.lit("")).alias("lang")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    fitted_on = docs.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {kind}")
    thresholds = checkpoint(language_thresholds(rows.where(~F.col("held_out")), clear_labels(labels, "toxic", held_out), F.broadcast(fitted_on))).withColumnRenamed("group", "lang")
    out = rows.join(F.broadcast(thresholds) if thresholds.count() <= MOST_GROUPS else thresholds, "lang", "left")  # no language and an empty name are one
    limit = F.coalesce("threshold", F.lit(0.5))
    return out.select("doc_id", "held_out", "score", limit.alias("threshold"), (F.col("score") >= limit).alias("flagged"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op5``: every row of ``documents``, with its language's threshold and flag as further columns."""
    scored = flag_toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
