"""Context-tree weighting over bytes, as arrays.

The next byte is coded as eight binary decisions. Each decision has a tree of contexts, the last 0 to
``depth`` bytes; a node holds how often the decision fell either way. With ``Pe`` the
Krichevsky-Trofimov probability of a node's decisions and ``Pw`` the weighted one,
``Pw = (Pe + prod Pw(children)) / 2``, and at full depth ``Pw = Pe``. The share of ``Pe`` is the weight
with which a prediction stops at the node; what is left goes to the next longer context. A context
that training never saw adds nothing: the mix ends at the longest one it saw.

A code is an integer of ``depth + 1`` bytes: the contexts from the latest byte on, then the byte
that follows. Trees are built in parts by their last two bytes; the two upper levels join the parts.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5


def codes_of(raw: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The code at every byte of a text (uint8 array) that follows a line end."""
    wide = np.concatenate([np.full(depth, 10, np.uint8), raw]).astype(np.uint64)
    out = np.zeros(len(raw), np.uint64)
    for i in range(1, depth + 1):  # latest byte first
        out = (out << np.uint64(8)) | wide[depth - i : depth - i + len(raw)]
    return (out << np.uint64(8)) | wide[depth:]


def shorten(codes: np.ndarray) -> np.ndarray:
    """The codes with their longest context byte left out."""
    return ((codes >> np.uint64(16)) << np.uint64(8)) | (codes & np.uint64(255))


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values at each."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[starts], *(np.add.reduceat(v[order], starts) for v in values))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series after eight steps up."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


class Level:
    """All nodes of one depth: key = context bytes, then 1 and the bits so far (1 to 255)."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.keys, self.a, self.b = keys, zeros.astype(np.float64), ones.astype(np.float64)
        self.log_w = self.stop = None

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray) -> Level:
        """From distinct codes of this depth in order."""
        keys, zeros, ones = [], [], []
        context, byte = codes & ~np.uint64(255), codes & np.uint64(255)
        for bit in range(8):
            node = context | np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))
            one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64) * counts
            k, n, o = summed(node, counts, one)
            keys.append(k)
            zeros.append(n - o)
            ones.append(o)
        return cls(*summed(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones)))

    def weigh(self, below: tuple[np.ndarray, np.ndarray] | None) -> None:
        """Weights, given (keys of this depth, sums of the children's ln Pw); none at full depth."""
        pe = log_kt(self.a, self.b)
        if below is None:
            self.log_w, self.stop = pe, np.ones(len(pe))
        else:
            children = np.zeros(len(pe))
            children[np.searchsorted(self.keys, below[0])] = below[1]
            self.log_w = np.logaddexp(pe, children) - np.log(2)
            self.stop = 1 / (1 + np.exp(np.clip(children - pe, -700, 700)))

    def to_parent(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(shorten(self.keys), self.log_w)


class Trees:
    """Levels ``low`` to ``depth`` from distinct codes of full depth with counts above 0."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int = DEPTH, low: int = 0):
        self.depth, self.low = depth, low
        self.levels: dict[int, Level] = {}
        for d in range(depth, low - 1, -1):
            self.levels[d] = Level.of(codes, counts)
            codes, counts = summed(shorten(codes), counts)
        below = None
        for d in range(depth, low - 1, -1):
            self.levels[d].weigh(below)
            below = self.levels[d].to_parent()
        self.below = below  # what the next level up needs

    def top(self) -> tuple[np.ndarray, ...]:
        """(keys, zeros, ones, ln Pw of the children) of this part's nodes one level above ``low``."""
        level = self.levels[self.low]
        return summed(shorten(level.keys), level.a, level.b, level.log_w)

    def add_top(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> None:
        """The levels above, from what all parts say of them."""
        below = (keys, children)
        for d in range(self.low - 1, -1, -1):
            level = self.levels[d] = Level(keys, zeros, ones)
            level.weigh(below)
            below = level.to_parent()
            keys, zeros, ones = summed(shorten(keys), zeros, ones)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's last byte after its contexts."""
        out = np.zeros(len(codes))
        byte = codes & np.uint64(255)
        for bit in range(8):
            node = np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))
            one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            key, p = (codes & ~np.uint64(255)) | node, np.full(len(codes), np.nan)
            for d in range(self.depth, -1, -1):
                level = self.levels[d]
                if len(level.keys):
                    at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
                    kt = (np.where(one, level.b[at], level.a[at]) + 0.5) / (level.a[at] + level.b[at] + 1)
                    mixed = np.where(np.isnan(p), kt, level.stop[at] * kt + (1 - level.stop[at]) * p)
                    p = np.where(level.keys[at] == key, mixed, p)
                key = shorten(key)
            out += np.log10(np.where(np.isnan(p), 0.5, p))
        return out
