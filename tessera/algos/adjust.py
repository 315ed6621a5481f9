"""Adjusted p-values that need all tests of a group at once."""

from __future__ import annotations

import numpy as np


def closed_simes(p: np.ndarray) -> np.ndarray:
    """Adjusted p-values by closed testing with Simes' test (Hommel's procedure), from the definition.

    At a level a, let h be the largest number m of tests for which Simes' test does not reject the m
    largest p-values together. A test is rejected at a if h times its p-value is at most a. Simes' test
    of the m largest has a p-value s(m), so h >= m up to t(m), the largest s from m on, and the adjusted
    p-value lies where the falling t crosses the rising m p.
    """
    n = len(p)
    if not n:
        return np.zeros(0)
    rising = np.sort(p)
    s = np.array([(m * rising[n - m :] / np.arange(1, m + 1)).min() for m in range(1, n + 1)])
    t = np.append(np.maximum.accumulate(s[::-1])[::-1], 0.0)  # t[m - 1] is t(m)
    above = t[:n] / np.arange(1, n + 1)  # falls: m p < t(m) holds for the first of them
    most = np.searchsorted(-above, -p, "left")
    return np.minimum(1.0, np.where(most == 0, t[0], np.maximum(t[most], most * p)))
