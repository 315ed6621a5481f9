"""Roots of the zero-count equations, for many lanes at once. Each lane stops for itself."""

from __future__ import annotations

import numpy as np

from tessera.functions.special import SMALL_DISPERSION


def within(target: np.ndarray, threshold: float) -> np.ndarray:
    """The threshold of each lane, but not below what doubles tell apart in a sum as large as its target."""
    return np.maximum(threshold, 4 * np.finfo(float).eps * np.abs(target))


def zero_probability(a: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Probability of a zero count, elementwise with broadcasting."""
    a, mu = np.broadcast_arrays(np.asarray(a, float), np.asarray(mu, float))
    with np.errstate(all="ignore"):
        small = np.exp((a - 1) * mu)
        large = np.exp(-np.log1p(a * mu) / a)
    out = np.where(a < SMALL_DISPERSION, small, large)
    out = np.where(np.isposinf(a), 1.0, out)
    out = np.where(np.isneginf(a), 0.0, out)
    return np.where(np.isnan(a) | np.isnan(mu), np.nan, out)


def dispersion_newton(lam, zeros, nu, weight=None, threshold=1e-3, max_iterations=100, strict=True) -> np.ndarray:
    """Dispersion of each gene so that the expected zeros, sum of weight * p0(a, lam * nu), meet the observed.

    No zero gives -inf, no count at all gives 1. A lane within the threshold at dispersion 0 still
    takes Newton steps, so a result does not depend on which genes share a batch. Lanes that do not
    converge raise, or are NaN if not ``strict``.
    """
    lam, zeros, nu = (np.asarray(x, float) for x in (lam, zeros, nu))
    weight = np.ones_like(nu) if weight is None else np.asarray(weight, float)
    out = np.full(len(lam), -np.inf)
    out[zeros >= weight.sum()] = 1.0
    todo = np.flatnonzero((zeros > 0) & (zeros < weight.sum()))
    negative = np.array([(weight * np.exp(-lam[i] * nu)).sum() >= zeros[i] for i in todo], bool)
    a = np.where(negative, -1.0, 1.0)
    for _ in range(max_iterations):
        if not len(todo):
            return out
        mu = lam[todo, None] * nu
        with np.errstate(all="ignore"):
            lp = np.where(negative[:, None], (a[:, None] - 1) * mu, -np.log1p(np.maximum(a[:, None] * mu, -1 + 1e-15)) / a[:, None])
            p = np.exp(lp)
            diff = (weight * p).sum(1) - zeros[todo]
            slope = np.where(negative[:, None], a[:, None] * mu * p, (mu / (a[:, None] * mu + 1) + lp) * p)
            step = (weight * slope).sum(1)
        done = np.abs(diff) <= within(zeros[todo], threshold)
        out[todo[done]] = a[done]
        go = ~done
        factor = np.maximum((step + np.where(negative, -diff, diff)) / step, 1e-8)
        a, todo, negative = (a * factor)[go], todo[go], negative[go]
    if len(todo) and strict:
        raise ArithmeticError(f"no convergence for {len(todo)} genes")
    out[todo] = np.nan
    return out


def _parts(lanes: np.ndarray, n: int) -> list[np.ndarray]:
    """Lanes in parts whose tables of ``n`` columns stay within 4 million values."""
    size = max(1, 4_000_000 // max(1, n))
    return [lanes[at : at + size] for at in range(0, len(lanes), size)]


def _bisect(count, x: np.ndarray, target: np.ndarray, move, threshold: float, max_iterations: int) -> np.ndarray:
    """Where the falling or rising ``count(x, lanes)`` meets the targets: steps away from ``x``, then halving, all lanes at once.

    A lane also ends where no double is left between its bounds: rounding of a large sum may keep it from the threshold.
    """
    x, lanes = np.array(x, float), np.arange(len(x))
    threshold, eps = within(target, threshold), np.finfo(float).eps
    diff = count(x, lanes) - target
    lanes = lanes[np.abs(diff) > threshold]
    sign, low, high = np.where(diff < 0, -1.0, 1.0), x.copy(), np.full(len(x), np.nan)
    for stage in ("bracket", "convergence"):
        open_ = lanes
        for _ in range(max_iterations):
            if not len(open_):
                break
            x[open_] = move(x[open_], sign[open_]) if stage == "bracket" else (low[open_] + high[open_]) / 2
            d = count(x[open_], open_) - target[open_]
            met, over = np.abs(d) <= threshold[open_], sign[open_] * d < 0
            lanes = np.setdiff1d(lanes, open_[met], assume_unique=True)
            high[open_[over]] = x[open_[over]]
            low[open_[~over]] = x[open_[~over]]
            if stage == "convergence":
                met |= np.abs(high[open_] - low[open_]) <= 2 * eps * np.abs(x[open_])
            open_ = open_[~met & ~over] if stage == "bracket" else open_[~met]
        if len(open_):
            raise ArithmeticError(f"no {stage}")
    return x


def dispersion_bisection(lam, zeros, nu, weight=None, threshold=1e-3, max_iterations=100) -> np.ndarray:
    """As ``dispersion_newton``, by doubling steps from 0 and bisection."""
    nu = np.asarray(nu, float)
    weight = np.ones_like(nu) if weight is None else np.asarray(weight, float)
    lam, zeros = np.asarray(lam, float), np.asarray(zeros, float)
    out = np.where(zeros == 0, -np.inf, 1.0)
    lanes = np.flatnonzero((zeros > 0) & (zeros < weight.sum()))
    for some in _parts(lanes, len(nu)):
        rate = lam[some, None] * nu
        count = lambda a, k, rate=rate: zero_probability(a[:, None], rate[k]) @ weight
        step = lambda a, sign: np.where(a == 0, -sign, 2 * a)
        out[some] = _bisect(count, np.zeros(len(some)), zeros[some], step, threshold, max_iterations)
    return out


def nu_bisection(zeros, lam, dispersion, guess, threshold=1e-3, max_iterations=100) -> np.ndarray:
    """Efficiency of each cell so that its expected zero genes meet the observed; no zero gives inf."""
    lam, dispersion = np.asarray(lam, float), np.asarray(dispersion, float)
    zeros, guess = np.asarray(zeros, float), np.asarray(guess, float)
    if (guess <= 0).any():
        raise ValueError("the first guess must be positive")
    out, lanes = np.full(len(zeros), np.inf), np.flatnonzero(zeros > 0)
    for some in _parts(lanes, len(lam)):
        count = lambda nu, k: zero_probability(dispersion, nu[:, None] * lam).sum(1)
        out[some] = _bisect(count, guess[some], zeros[some], lambda nu, sign: nu * 2**sign, threshold, max_iterations)
    return out


def _zeros_and_slopes(a: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p0, and its derivatives by the dispersion and by the logarithm of mu."""
    p, a = zero_probability(a[:, None], mu), a[:, None]
    small = a < SMALL_DISPERSION
    with np.errstate(all="ignore"):
        ratio = mu / (1 + a * mu)
        by_a = np.where(small, mu * p, p * (np.log1p(a * mu) / a - ratio) / a)
        by_mu = np.where(small, (a - 1) * mu * p, -ratio * p)
    return p, by_a, by_mu


def fit_zeros(lam, zero_genes, zero_cells, nu, threshold=1e-3, max_iterations=50, average_to_one=True) -> tuple[np.ndarray, np.ndarray]:
    """(dispersions, efficiencies) whose expected zeros fit those of genes and cells in the mean square."""
    a, log_nu = np.zeros(len(lam)), np.log(np.asarray(nu, float))
    n = len(a) + len(log_nu) + 1

    def look(a, log_nu):
        p, by_a, by_mu = _zeros_and_slopes(a, lam[:, None] * np.exp(log_nu))
        by_gene, by_cell = p.sum(1) - zero_genes, p.sum(0) - zero_cells
        mean = np.exp(log_nu).mean() - 1 if average_to_one else 0.0
        return (by_gene, by_cell, mean, by_a, by_mu), float(np.sqrt(((by_gene**2).sum() + (by_cell**2).sum() + mean**2) / n))

    found, error = look(a, log_nu)
    for _ in range(max_iterations):
        stuck = True
        for dispersions in (True, False):
            by_gene, by_cell, mean, by_a, by_mu = found
            if error <= threshold:
                return a, np.exp(log_nu)
            if dispersions:  # each gene by its own equation, then each cell
                step = np.clip(-by_gene / (by_a.sum(1) + 1e-9), -1, 1)
            else:
                step = np.clip(-by_cell / (by_mu.sum(0) - 1e-9), -0.5, 0.5)
                step -= np.log(np.exp(log_nu + step).mean()) if average_to_one else 0.0
            rate = 1.0
            while rate > 1e-3:
                now = (a + rate * step, log_nu) if dispersions else (a, log_nu + rate * step)
                after, new = look(*now)
                if new < error:
                    (a, log_nu), found, error, stuck = now, after, new, False
                    break
                rate /= 2
        if stuck:
            break
    return a, np.exp(log_nu)
