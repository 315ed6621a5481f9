"""Exact substring deduplication with a logarithmic family of suffix arrays.

A byte goes if a string of ``span`` bytes over it also starts in a document with a smaller id.

Suffixes are sampled by content: in every string of ``span`` bytes the ``GRAM`` bytes with the
smallest hash are its anchor, so equal strings share their anchor wherever they stand. Consecutive
strings with the same anchor form a piece, and pieces are dealt to buckets by the anchor's hash; all
occurrences of a string meet in one bucket. To move little text, blocks first ask which anchors
occur in more than one document at all, then send the pieces of those alone, each text once a block.
A bucket has each text once, under its smallest id, and judges every occurrence by the smallest ids
of the text's strings.
The pieces of an anchor with more than ``HOT`` strings in the corpus are sent string by string, each
to the bucket of its own hash, so no anchor makes a bucket large.

A bucket takes its pieces in order of their smallest document ids, in batches. A batch gets a suffix
array: the positions of its strings in its text, in the strings' order, each distinct string once with
the smallest id that has it. It is merge-scanned against the arrays of the levels before it and
becomes a level itself; levels of like size are merged, so that their sizes grow geometrically and
each suffix is merged a logarithmic number of times. ``Family`` can be kept between runs: its levels
are plain arrays, and a later batch of larger ids only needs ``add``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.blocks import deal, pack_small, pack_sorted, unpack_small, unpack_sorted
from tessera.llm.common import table

SPAN, GRAM = 50, 16
#: Strings whose anchors are found at once; suffixes in a batch of the family, and those of a level that are scanned at once.
SEGMENT, BATCH, SCAN = 65_536, 400_000, 200_000
#: Above so many strings an anchor is hot.
HOT = 500_000
#: The id of rows without one: no document is after it.
NO_ID = np.iinfo(np.int64).max
_POSITION = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    raw = data.tobytes()
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy()
    return _mix(_mix(words[: len(words) - 8]) * np.uint64(0x9E3779B97F4A7C15) + words[8:])


def anchors(data: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """For every string of ``span`` bytes: (position, hash) of its anchor, the leftmost of equals."""
    n = len(data) - span + 1
    at, key = np.empty(max(n, 0), np.int64), np.empty(max(n, 0), np.uint64)
    width = span - GRAM + 1
    for s in range(0, n, SEGMENT):
        e = min(n, s + SEGMENT)
        h = _grams(data[s : e + span - 1])
        low = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if width > reach:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        best = (low & _POSITION).astype(np.int64)
        at[s:e], key[s:e] = best + s, h[best]
    return at, key


class Block:
    """The texts of a block in an order that depends on the documents alone, one after the other."""

    def __init__(self, part: pa.Table):
        ids = [NO_ID if i is None else int(i) for i in part["doc_id"].to_pylist()]
        texts = [t.encode() for t in part["text"].to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        self.texts = [texts[i] for i in self.order]
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


class Pieces(Block):
    """The pieces of a block: where each starts, its number of strings, document and anchor."""

    def __init__(self, part: pa.Table, span: int):
        super().__init__(part)
        self.raw, self.span = b"".join(self.texts), span
        at, key = anchors(np.frombuffer(self.raw, np.uint8), span)
        lengths = np.diff(self.starts)
        doc = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
        whole = np.arange(len(at)) + span <= self.starts[doc + 1] if len(at) else np.zeros(0, bool)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
        self.first = np.flatnonzero(new & whole)  # position of a piece's first string
        stops = np.flatnonzero(np.append(new | ~whole, True)[1:]) + 1 if len(at) else np.zeros(0, np.int64)
        self.count = stops[np.searchsorted(stops, self.first, side="right")] - self.first if len(self.first) else self.first
        self.doc, self.key = doc[self.first], key[self.first]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(keys) % np.uint64(buckets)).astype(np.int64)


def _short(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(16)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in ``ordered`` (in order)."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _by_bucket(bucket: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The buckets that have entries, and which."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, order[edges[b] : edges[b + 1]]) for b in np.flatnonzero(np.diff(edges)).tolist()]


def _ask(buckets: int, span: int):
    """Which anchors a block has, which of them in two or more documents, and how many strings of each."""

    def run(key, part):
        pieces = Pieces(part, span)
        order = np.argsort(pieces.key, kind="stable")  # pieces are in order of documents
        keys, docs = pieces.key[order], pieces.ids[pieces.doc[order]]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(keys)) - 1
        several = docs[ends] != docs[starts] if len(starts) else np.zeros(0, bool)
        strings = np.add.reduceat(pieces.count[order], starts) if len(starts) else np.zeros(0, np.int64)
        keys = keys[starts]
        rows = _by_bucket(_bucket(keys, buckets), buckets)
        # two anchors of one block may share their short key: then both are taken for repeated
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in rows], pa.int32()),
                "block": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                "keys": pa.array([pack_sorted(_short(keys[r])) for _, r in rows], pa.binary()),
                "several": pa.array([np.packbits(several[r]).tobytes() for _, r in rows], pa.binary()),
                "strings": pa.array([pack_small(strings[r]) for _, r in rows], pa.binary()),
            }
        )

    return run


def _repeated(hot: int):
    """The repeated anchors of each block, and those of them that are hot."""

    def run(key, part):
        keys = [unpack_sorted(k.as_py()) for k in part["keys"]]
        several = [np.unpackbits(np.frombuffer(s.as_py(), np.uint8), count=len(k)).astype(bool) for s, k in zip(part["several"], keys, strict=True)]
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(new)
        strings = np.concatenate([unpack_small(s.as_py(), len(k)) for s, k in zip(part["strings"], keys, strict=True)])
        total = np.add.reduceat(strings[order], starts)
        twice = (np.diff(np.append(starts, len(ranked))) > 1) | np.logical_or.reduceat(np.concatenate(several)[order], starts)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        edges = np.cumsum([0, *map(len, keys)])
        out, large = [], []
        for k, i, j in zip(keys, edges[:-1], edges[1:], strict=True):
            use = twice[place[i:j]]
            out.append(pack_sorted(k[use]))
            large.append(pack_sorted(k[use & (total[place[i:j]] > hot)]))
        return pa.table({"block": part["block"], "keys": pa.array(out, pa.binary()), "hot": pa.array(large, pa.binary())})

    return run


def _compress(raw: bytes) -> bytes:
    import zstandard

    return zstandard.compress(raw, 1)


def _expand(raw: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(raw)


def _send(buckets: int, span: int):
    """The pieces of repeated anchors, each text once a block, and where it occurs."""

    def run(key, part, replies):
        from xxhash import xxh64_intdigest

        pieces = Pieces(part, span)
        none = [np.zeros(0, np.uint64)]
        twice, hot = (np.sort(np.concatenate([*none, *(unpack_sorted(k.as_py()) for k in replies[c])])) for c in ("keys", "hot"))
        short = _short(pieces.key)
        some = np.flatnonzero(_among(short, twice))
        first, count, doc, anchor = (x[some] for x in (pieces.first, pieces.count, pieces.doc, pieces.key))
        if len(hot):  # strings instead of pieces, by a hash of their own
            large = _among(short[some], hot)
            n = count[large]
            one = np.repeat(first[large] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = np.array([xxh64_intdigest(pieces.raw[i : i + span]) for i in one.tolist()], np.uint64)
            first, count = np.concatenate([first[~large], one]), np.concatenate([count[~large], np.ones(len(one), np.int64)])
            doc, anchor = np.concatenate([doc[~large], np.repeat(doc[large], n)]), np.concatenate([anchor[~large], own])
        seen: dict[bytes, int] = {}
        raw, ends = pieces.raw, (first + count + span - 1).tolist()
        text = np.array([seen.setdefault(raw[i:j], k) for k, (i, j) in enumerate(zip(first.tolist(), ends, strict=True))], np.int64)
        rows = []
        for b, at in _by_bucket(_bucket(anchor, buckets), buckets):
            held, which = np.unique(text[at], return_inverse=True)
            rows.append(
                (
                    b,
                    _compress(first[at].astype("<u4").tobytes()),
                    _compress(pieces.ids[doc[at]].astype("<i8").tobytes()),
                    _compress(which.astype("<u4").tobytes()),
                    _compress(count[held].astype("<u4").tobytes()),
                    _compress(b"".join([raw[first[k] : ends[k]] for k in held.tolist()])),
                )
            )
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.table(
            {
                "bucket": pa.array(columns[0], pa.int32()),
                "block": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                **{n: pa.array(c, pa.binary()) for n, c in zip(("at", "doc", "which", "size", "text"), columns[1:], strict=True)},
            }
        )

    return run


def _windows(text: bytes, at: np.ndarray, span: int) -> np.ndarray:
    """The strings of ``span`` bytes at some positions."""
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), span)[at]
    return np.ascontiguousarray(rows).view(f"S{span}").ravel()


class Level:
    """A suffix array of depth ``span``: positions in ``text`` in the order of their strings, the smallest id of each."""

    def __init__(self, text: bytes, at: np.ndarray, least: np.ndarray):
        self.text, self.at, self.least = text, at, least


class Family:
    """Suffix arrays of geometrically growing size."""

    def __init__(self, span: int = SPAN):
        self.span, self.levels = span, []

    def _array(self, text: bytes, at: np.ndarray, ids: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
        """(suffix array of distinct strings, its strings, place of each input)."""
        strings = _windows(text, at, self.span)
        order = np.argsort(strings, kind="stable")  # merges runs that are in order already
        ranked = strings[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(new)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return Level(text, at[order[starts]], np.minimum.reduceat(ids[order], starts)), ranked[starts], place

    def _merged(self, one: Level, two: Level) -> Level:
        """Two suffix arrays as one. At most ``SCAN`` strings of either are looked at together."""
        ats, leasts, i, j = [], [], 0, 0
        while i < len(one.at) or j < len(two.at):
            left, right = _windows(one.text, one.at[i : i + SCAN], self.span), _windows(two.text, two.at[j : j + SCAN], self.span)
            # what is not yet seen of either comes after the last string that is
            limits = [x[-1] for x, rest in ((left, len(one.at) - i), (right, len(two.at) - j)) if rest > len(x)]
            n, m = (np.searchsorted(x, min(limits), "right") if limits else len(x) for x in (left, right))
            strings = np.concatenate([left[:n], right[:m]])
            order = np.argsort(strings, kind="stable")  # merges the two runs
            ranked = strings[order]
            new = np.ones(len(ranked), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            starts = np.flatnonzero(new)
            ats.append(np.concatenate([one.at[i : i + n], two.at[j : j + m] + len(one.text)])[order[starts]])
            leasts.append(np.minimum.reduceat(np.concatenate([one.least[i : i + n], two.least[j : j + m]])[order], starts))
            i, j = i + n, j + m
        return Level(one.text + two.text, np.concatenate(ats), np.concatenate(leasts))

    def add(self, text: bytes, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Adds a batch of strings, by position in ``text``; the smallest id so far of each."""
        if not len(at):
            return np.zeros(0, np.int64)
        own, strings, place = self._array(text, at, ids)
        smallest = own.least.copy()
        for level in self.levels:
            for s in range(0, len(level.at), SCAN):  # both are in order: a part of the level meets a part of the batch
                part = _windows(level.text, level.at[s : s + SCAN], self.span)
                i, j = np.searchsorted(strings, part[0], "left"), np.searchsorted(strings, part[-1], "right")
                where = np.minimum(np.searchsorted(part, strings[i:j]), len(part) - 1)
                same = part[where] == strings[i:j]
                smallest[i:j][same] = np.minimum(smallest[i:j][same], level.least[s + where[same]])
        while self.levels and len(self.levels[-1].at) < 2 * len(own.at):
            own = self._merged(self.levels.pop(), own)
        self.levels.append(own)
        return smallest[place]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges of ``counts`` integers from ``starts`` on, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _match(span: int):
    """(block, from, to): the strings of a block, by position, that a smaller document has."""

    def run(key, part):
        made = {n: [] for n in ("block", "at", "doc", "which")}
        seen: dict[bytes, int] = {}  # a text of several blocks is in the family once, under its smallest id
        for i in range(part.num_rows):
            row = {n: part[n][i].as_py() for n in ("block", "at", "doc", "which", "size", "text")}
            at, which, size = (np.frombuffer(_expand(row[n]), "<u4") for n in ("at", "which", "size"))
            raw, ends = _expand(row["text"]), np.cumsum(size.astype(np.int64) + span - 1).tolist()
            place = np.array([seen.setdefault(raw[i:j], len(seen)) for i, j in itertools.pairwise([0, *ends])], np.int32)
            for n, x in (("block", np.full(len(at), row["block"], np.int32)), ("at", at), ("doc", np.frombuffer(_expand(row["doc"]), "<i8")), ("which", place[which])):
                made[n].append(x)
        block, at, doc, which = (np.concatenate(made.pop(n)) for n in ("block", "at", "doc", "which"))
        at, texts, known = at.astype(np.int64), list(seen), len(seen)
        del seen
        size = np.fromiter(map(len, texts), np.int64, known) - span + 1
        least = np.full(known, NO_ID)
        np.minimum.at(least, which, doc)
        family, found = Family(span), []
        order = np.argsort(least, kind="stable")
        cuts = np.searchsorted(np.cumsum(size[order]), np.arange(BATCH, size[order].sum() + BATCH, BATCH)) + 1
        # occurrences in other documents than a text's smallest one: the family has each of its strings under a smaller id
        later = np.flatnonzero(doc > least[which])
        leaders = np.flatnonzero(doc == least[which])
        leaders = leaders[np.argsort(which[leaders], kind="stable")]
        low, high = np.searchsorted(which[leaders], np.arange(known), "left"), np.searchsorted(which[leaders], np.arange(known), "right")
        begin = 0
        for end in cuts.tolist():
            own = order[begin:end]
            begin = max(begin, end)
            if not len(own):
                continue
            own_text = b"".join([texts[k] for k in own.tolist()])
            places = np.cumsum(size[own] + span - 1) - (size[own] + span - 1)
            ids = np.repeat(least[own], size[own])
            hit = np.concatenate([[False], family.add(own_text, _spread(places, size[own]), ids) < ids, [False]])
            edge = np.zeros(len(hit) - 1, bool)  # where a text ends, a run of hits ends
            edge[np.cumsum(size[own])] = edge[0] = True
            rise = np.flatnonzero(hit[1:] & (~hit[:-1] | edge))
            fall = np.flatnonzero(hit[:-1] & (~hit[1:] | edge))
            ends = np.cumsum(size[own])
            of = np.searchsorted(ends, rise, "right")
            begins = ends - size[own]
            n = (high - low)[own[of]]
            who = leaders[_spread(low[own[of]], n)]
            found.append((block[who], at[who] + np.repeat(rise - begins[of], n), at[who] + np.repeat(fall - begins[of], n)))
        found.append((block[later], at[later], at[later] + size[which[later]]))
        block, low, high = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        order = np.argsort(block, kind="stable")
        own, first = np.unique(block[order], return_index=True)
        rows = np.split(order, first[1:]) if len(own) else []
        blob = [_compress(np.stack([low[r], high[r]]).astype("<u4").tobytes()) for r in rows]
        return pa.table({"block": pa.array(own.astype(np.int32)), "marks": pa.array(blob, pa.binary())})

    return run


def _remove(span: int, keep_text: bool):
    def run(key, part, replies):
        texts = Block(part)
        n = int(texts.starts[-1])
        change = np.zeros(n + 1, np.int32)
        for m in replies["marks"]:
            low, high = np.frombuffer(_expand(m.as_py()), "<u4").reshape(2, -1).astype(np.int64)
            np.add.at(change, low, 1)
            np.add.at(change, high + span - 1, -1)
        gone = np.cumsum(change)[:n] > 0
        out: dict[int, tuple] = {}
        for i, t in enumerate(texts.texts):
            own = gone[texts.starts[i] : texts.starts[i + 1]]
            removed = int(np.count_nonzero(own))
            if removed:
                spans = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).reshape(-1, 2).tolist()
                kept = np.frombuffer(t, np.uint8)[~own].tobytes()
            else:
                spans, kept = [], t
            out[texts.order[i]] = (len(t), removed, spans, kept)
        rows = [out[i] for i in range(len(out))]
        columns = {
            "doc_id": part["doc_id"],
            "n_bytes": pa.array([r[0] for r in rows], pa.int64()),
            "n_removed": pa.array([r[1] for r in rows], pa.int64()),
            "spans": pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int64()))),
            "kept_sha256": pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string()),
        }
        if keep_text:
            columns["kept"] = pa.array([r[3] for r in rows], pa.binary())
        return pa.table(columns)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, keep_text: bool = True, hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, spans, kept_sha256`` and, if asked for, ``kept``.

    ``spans`` are the maximal removed runs as ``[from, to)`` in bytes, ``kept`` the bytes that remain
    (a run may begin or end within a character). Ids are integers. Null texts count as empty, texts
    shorter than ``span`` lose nothing; a string that repeats within one document, or in rows with
    the same id, does not go for that. A null id is larger than any other. A text is worked on as a
    whole, so a task must hold its largest one, of 4 GB at most. Other columns are ignored; an empty
    table gives an empty result.
    """
    dealt, buckets = deal(docs, id_col, text_col)
    by_block = dealt.groupBy("block")
    asked = by_block.applyInArrow(_ask(buckets, span), "bucket int, block int, keys binary, several binary, strings binary")
    repeated = asked.groupBy("bucket").applyInArrow(_repeated(hot), "block int, keys binary, hot binary")
    sent = by_block.cogroup(repeated.groupBy("block")).applyInArrow(
        _send(buckets, span), "bucket int, block int, at binary, doc binary, which binary, size binary, text binary"
    )
    matched = sent.groupBy("bucket").applyInArrow(_match(span), "block int, marks binary")
    kind = dealt.schema["doc_id"].dataType.simpleString()
    return by_block.cogroup(matched.groupBy("block")).applyInArrow(
        _remove(span, keep_text),
        f"doc_id {kind}, n_bytes long, n_removed long, spans array<array<bigint>>, kept_sha256 string" + ", kept binary" * keep_text,
    )


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op4``: every row of ``documents``."""
    from pyspark.sql import functions as F

    out = remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
