"""Language-model scores by context-tree weighting (see ``ctw``), and unigram scores beside them.

A text is its words, A-Z in lower case, with one space between and a line end after the last: bytes
that the model codes one by one. All counts come from all training documents and grow with them.
Each block of documents sends its distinct words and byte contexts to buckets; a bucket adds up its
part of the corpus, builds its part of the context trees and answers with the count of each word and
the log probability of each code. The upper two levels of the trees, at most 256 contexts, are summed
over the buckets and given to each. Nothing else is broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blocks import deal, pack_small, pack_sorted, unpack_small, unpack_sorted
from tessera.llm.common import fold_of, table
from tessera.llm.ctw import DEPTH, Trees, codes_of, summed

#: The token that ends a text; no word is equal to it.
END = b"\n"
#: Contexts that share their last so many bytes are in one bucket.
ROOT = 2


def canonical(text: str) -> tuple[list[bytes], bytes]:
    """The words of a text, and its bytes with the line end."""
    words = text.encode().lower().split()
    return words, b" ".join(words) + END


def _word_keys(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _is_training(ids: pa.ChunkedArray, held_out: int) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 5 != held_out for i in ids.to_pylist()], bool)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _code_bucket(codes: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    return (_mixed(codes >> np.uint64(8 * (depth + 1 - ROOT))) % np.uint64(buckets)).astype(np.int64)


def _word_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(keys) % np.uint64(buckets)).astype(np.int64)


def _split(keys: np.ndarray, bucket: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """Positions of the keys of each bucket that has some, in the keys' order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return {b: order[edges[b] : edges[b + 1]] for b in np.flatnonzero(np.diff(edges)).tolist()}


class BlockView:
    """What a block of texts holds, the same whenever it is taken: words, codes, and the distinct ones in order."""

    def __init__(self, part: pa.Table, held_out: int, depth: int):
        self.training = _is_training(part["doc_id"], held_out)
        texts = [canonical(t.as_py()) for t in part["text"]]
        self.words = [[*w, END] for w, _ in texts]
        self.lengths = np.array([len(b) for _, b in texts], np.int64)
        codes = [codes_of(np.frombuffer(b, np.uint8), depth) for _, b in texts]
        self.codes = np.concatenate([np.zeros(0, np.uint64), *codes])
        distinct = list(set().union(*self.words)) if self.words else []
        self.keys, place = np.unique(_word_keys(distinct), return_inverse=True)
        self.number = dict(zip(distinct, place.tolist(), strict=True))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how often each word occurs in the training texts, the distinct codes, and how often each of them does)."""
        words = Counter()
        for ws, t in zip(self.words, self.training, strict=True):
            if t:
                words.update(ws)
        word_counts = np.zeros(len(self.keys), np.int64)
        np.add.at(word_counts, [self.number[w] for w in words], list(words.values()))
        distinct = _distinct(np.sort(self.codes))[0]
        known, n = _distinct(np.sort(self.codes[np.repeat(self.training, self.lengths)]))
        counts = np.zeros(len(distinct), np.int64)
        counts[np.searchsorted(distinct, known)] = n
        return word_counts, distinct, counts


def _distinct(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an array in order, and how often each occurs."""
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    return ranked[starts], np.diff(np.append(starts, len(ranked)))


def _ask(buckets: int, held_out: int, depth: int):
    def run(key, part):
        view = BlockView(part, held_out, depth)
        word_counts, distinct, code_counts = view.counts()
        words = _split(view.keys, _word_bucket(view.keys, buckets), buckets)
        codes = _split(distinct, _code_bucket(distinct, buckets, depth), buckets)
        some, none = sorted({*words, *codes}), np.zeros(0, np.int64)
        words, codes = ([of.get(b, none) for b in some] for of in (words, codes))
        return pa.table(
            {
                "bucket": pa.array(some, pa.int32()),
                "block": pa.array([key[0].as_py()] * len(some), pa.int32()),
                "words": pa.array([pack_sorted(view.keys[i]) for i in words], pa.binary()),
                "word_counts": pa.array([pack_small(word_counts[i]) for i in words], pa.binary()),
                "codes": pa.array([pack_sorted(distinct[i]) for i in codes], pa.binary()),
                "code_counts": pa.array([pack_small(code_counts[i]) for i in codes], pa.binary()),
            }
        )

    return run


def _gather(part: pa.Table, name: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    keys = [unpack_sorted(x.as_py()) for x in part[f"{name}s"]]
    return keys, [unpack_small(x.as_py(), len(k)) for x, k in zip(part[f"{name}_counts"], keys, strict=True)]


def _known(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys that occur in training, and their counts."""
    k, n = summed(np.concatenate(keys), np.concatenate(counts))
    return k[n > 0], n[n > 0]


def _summarise(depth: int):
    """What the upper levels and the totals need to know of a bucket."""

    def run(key, part):
        words, word_counts = _known(*_gather(part, "word"))
        keys, zeros, ones, below = Trees(*_known(*_gather(part, "code")), depth, ROOT).top()
        return pa.table(
            {
                # row 0 has the totals of the words: how many, and how many distinct
                "node": pa.array(np.concatenate([[0], keys.astype(np.int64)])),
                "zeros": pa.array(np.concatenate([[float(word_counts.sum())], zeros])),
                "ones": pa.array(np.concatenate([[float(len(words))], ones])),
                "below": pa.array(np.concatenate([[0.0], below])),
            }
        )

    return run


def _answer(depth: int):
    def run(key, part, top):
        words, word_counts = _gather(part, "word")
        codes, code_counts = _gather(part, "code")
        known, n = _known(words, word_counts)
        trees = Trees(*_known(codes, code_counts), depth, ROOT)
        order = np.argsort(top["node"].to_numpy())
        node, zeros, ones, below = (top[c].to_numpy()[order] for c in ("node", "zeros", "ones", "below"))
        trees.add_top(node[1:].astype(np.uint64), zeros[1:], ones[1:], below[1:])
        asked = np.unique(np.concatenate(codes))
        log10 = trees.log10(asked).astype("<f8")
        replies = []
        for w, c in zip(words, codes, strict=True):
            found = np.zeros(len(w), np.int64)
            if len(known) and len(w):
                at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                found = np.where(known[at] == w, n[at], 0)
            replies.append((pack_small(found), log10[np.searchsorted(asked, c)].tobytes()))
        return pa.table(
            {
                "block": part["block"],
                "bucket": part["bucket"],
                "counts": pa.array([r[0] for r in replies], pa.binary()),
                "log10": pa.array([r[1] for r in replies], pa.binary()),
                "total": pa.array([int(zeros[0])] * len(replies), pa.int64()),
                "distinct": pa.array([int(ones[0])] * len(replies), pa.int64()),
            }
        )

    return run


def _score(buckets: int, held_out: int, depth: int):
    def run(key, part, replies):
        import pandas as pd

        view = BlockView(part, held_out, depth)
        label, distinct = pd.factorize(view.codes)
        ranked = np.argsort(distinct)
        counts, logs = np.zeros(len(view.keys), np.int64), np.zeros(len(distinct))
        words = _split(view.keys, _word_bucket(view.keys, buckets), buckets)
        codes = _split(distinct, _code_bucket(distinct[ranked], buckets, depth), buckets)
        for i, b in enumerate(replies["bucket"].to_pylist()):
            if b in words:
                counts[words[b]] = unpack_small(replies["counts"][i].as_py(), len(words[b]))
            if b in codes:
                logs[ranked[codes[b]]] = np.frombuffer(replies["log10"][i].as_py(), "<f8")
        total, distinct = replies["total"][0].as_py(), replies["distinct"][0].as_py()
        each = logs[label]
        starts = np.concatenate([[0], np.cumsum(view.lengths)[:-1]]).astype(np.int64)
        rest = np.log10(total + 0.5 * (distinct + 1))
        n_tokens, n_known, base = [], [], []
        for ws in view.words:
            c = counts[np.fromiter(map(view.number.__getitem__, ws), np.int64, len(ws))]
            n_tokens.append(len(ws))
            n_known.append(int((c > 0).sum()))
            base.append(float(np.log10(c + 0.5).sum() - len(ws) * rest))
        return pa.table(
            {
                "doc_id": part["doc_id"],
                "held_out": pa.array(~view.training),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([total] * len(base), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(np.add.reduceat(each, starts) if len(starts) else [], pa.float64()),
                "n_bytes": pa.array(view.lengths),
            }
        )

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1, depth: int = DEPTH) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes``.

    ``score`` is the log10 probability of the text under the context trees, ``n_bytes`` the bytes it
    covers, so ``-score / n_bytes * log2(10)`` is the code length in bits per byte. Null and empty
    texts consist of the end token alone. Repeated rows are counted and scored each. Other columns
    are ignored; an empty table gives an empty result. Without training documents every decision
    has probability one half.
    """
    if not ROOT <= depth <= 7:
        raise ValueError(f"a depth from {ROOT} to 7: a code is a 64-bit integer")
    dealt, buckets = deal(docs, id_col, text_col)
    by_block = dealt.groupBy("block")
    asked = by_block.applyInArrow(
        _ask(buckets, held_out, depth), "bucket int, block int, words binary, word_counts binary, codes binary, code_counts binary"
    )
    top = (
        asked.groupBy("bucket")
        .applyInArrow(_summarise(depth), "node long, zeros double, ones double, below double")
        .groupBy("node")
        .agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    )
    # at most 256 contexts of 255 nodes and the totals, one copy a bucket
    copies = top.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "*")
    answered = (
        asked.groupBy("bucket")
        .cogroup(copies.groupBy("bucket"))
        .applyInArrow(_answer(depth), "block int, bucket int, counts binary, log10 binary, total long, distinct long")
    )
    kind = dealt.schema["doc_id"].dataType.simpleString()
    return by_block.cogroup(answered.groupBy("block")).applyInArrow(
        _score(buckets, held_out, depth),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long",
    )


def op6_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op6``: every row of ``documents``."""
    return score_texts(table(spark, sf_dir, "documents"))
