"""Best-fit packing of tokenised documents into sequences of fixed length.

One pass without a shuffle. Every task tokenises its documents and packs their pieces by
bounded-space best fit: at most ``open_bins`` bins are open, a bitset holds the free spaces that
occur among them, the lowest set bit at or above a piece's length is the bin that it fits best, and
when a new bin is needed while all are open the fullest is closed. A piece's place is known when it
is placed, so rows leave at once and a task holds one chunk of documents and the open bins' free
spaces. Within a chunk pieces are placed longest first.

Tokens come from a vocabulary file. Where that is a plain byte-level BPE, its merges are run by a
faster engine that gives the same ids; texts with characters whose class the two engines' Unicode
tables might see differently, texts with very long runs of white space and files of any other kind go
through the tokenizer itself. Neither way remembers texts, so a worker's memory is that of a chunk.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, table, trimmed

LENGTH, END_ID, OPEN_BINS = 2048, 0, 4096
#: A chunk of documents ends at so many bytes of text or rows.
CHUNK_BYTES, CHUNK_ROWS = 4_000_000, 20_000
SCHEMA = "piece int, start long, length long, ids binary, sequence_id long, offset long"

#: Fixed value: the byte-level pattern of the vocabulary's family, as published with it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Latin, Greek, Cyrillic, punctuation, kana and unified ideographs: classes that no Unicode version has changed.
_UNUSUAL = re.compile("[^\x00-\u04ff\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")
#: The pattern backtracks over white space; runs of this length are left to the tokenizer.
_RUN, _LONG = re.compile(r"\s{10000}"), 10_000


def _engine(path: str):
    """The fast engine of a vocabulary file, or None where the file is no plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and not spec.get("normalizer")
        and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
        and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not plain:
        return None
    # printable bytes stand for themselves, the others for the characters from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in added}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocab.get("".join(m), -1) for m in merged]
    if any(c not in of for t in vocab for c in t) or ids != sorted(set(ids)) or len(ids) != len(vocab) - 256:
        return None  # the engine merges in the order of ids
    import tiktoken

    ranks = {bytes(of[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special, explicit_n_vocab=None)


class Encoder:
    """ids of texts, as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.engine = _engine(path)

    def _slow(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _usual(self, text: str) -> bool:
        return (text.isascii() or not _UNUSUAL.search(text)) and (len(text) < _LONG or not _RUN.search(text))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.engine is None:
            return self._slow(texts)
        fast, slow = self.engine.encode_to_numpy, [i for i, t in enumerate(texts) if not self._usual(t)]
        other = dict(zip(slow, self._slow([texts[i] for i in slow]), strict=True))
        return [other[i] if i in other else fast(t, allowed_special="all").astype("<u4", copy=False).tobytes() for i, t in enumerate(texts)]


class Bins:
    """Bounded-space best fit: ``place`` gives (number of the bin, offset in it)."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.free: list[list[int]] = [[] for _ in range(length + 1)]
        self.mask = self.open = self.made = 0

    def _take(self, f: int) -> int:
        got = self.free[f].pop()
        if not self.free[f]:
            self.mask &= ~(1 << f)
        return got

    def place(self, n: int) -> tuple[int, int]:
        if n < self.length and (fits := self.mask >> n):
            f = n + (fits & -fits).bit_length() - 1
            number = self._take(f)
        else:
            f, number = self.length, self.made
            self.made += 1
            if n < self.length and self.open == self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
                self.open -= 1
            self.open += n < self.length
        if left := f - n:
            self.free[left].append(number)
            self.mask |= 1 << left
        elif f < self.length:
            self.open -= 1
        return number, self.length - f


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: only the first may be shorter."""
    head = n % length
    return ([(0, head)] if head else []) + [(at, length) for at in range(head, n, length)]


def _packer(path: str, length: int, end_id: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _encoder(path)
        bins, base = Bins(length, open_bins), TaskContext.get().partitionId() << 36
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            texts, at = batch.column(batch.num_columns - 1), 0
            while at < batch.num_rows:
                stop, size = at, 0
                while stop < batch.num_rows and stop - at < CHUNK_ROWS and size < CHUNK_BYTES:
                    size += len(texts[stop].as_buffer() or b"") if texts[stop].is_valid else 0
                    stop += 1
                ids = [x + end for x in encode([t or "" for t in texts.slice(at, stop - at).to_pylist()])]
                pieces = [(row, k, s, n) for row, x in enumerate(ids) for k, (s, n) in enumerate(cut(len(x) // 4, length))]
                pieces.sort(key=lambda p: -p[3])
                places = [bins.place(p[3]) for p in pieces]
                columns = [batch.column(i).take(pa.array([at + p[0] for p in pieces], pa.int64())) for i in range(batch.num_columns - 1)]
                columns += [
                    pa.array([p[1] for p in pieces], pa.int32()),
                    pa.array([p[2] for p in pieces], pa.int64()),
                    pa.array([p[3] for p in pieces], pa.int64()),
                    pa.array([ids[p[0]][4 * p[2] : 4 * (p[2] + p[3])] for p in pieces], pa.binary()),
                    pa.array([base + b for b, _ in places], pa.int64()),
                    pa.array([o for _, o in places], pa.int64()),
                ]
                names = batch.schema.names[:-1] + ["piece", "start", "length", "ids", "sequence_id", "offset"]
                for i in range(0, len(pieces), 4096):
                    yield pa.RecordBatch.from_arrays([c.slice(i, 4096) for c in columns], names=names)
                at = stop

    return run


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    open_bins: int = OPEN_BINS,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    ``ids`` holds little-endian unsigned 32-bit token ids; the end id closes every document, so a
    null or empty text is one piece of one token. Repeated rows are packed each for itself, a null
    id is kept, other columns are ignored. Documents longer than ``length`` are cut into pieces of
    that length, but for the first, which takes the rest. An empty table gives an empty result.
    ``vocabulary`` is the path of a tokenizer file (default: the public byte-level BPE).
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(_packer(str(vocabulary), length, end_id, open_bins)), f"doc_id {kind}, {SCHEMA}")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op3``: every piece of ``documents``."""
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
