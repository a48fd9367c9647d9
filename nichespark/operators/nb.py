"""Negative binomial regression for a block of genes in numpy: ridge IRLS and moderated dispersions."""

from __future__ import annotations

import numpy as np

from ..functions.special import lgamma

#: Grid of log dispersions on which profile likelihoods are kept.
GRID = np.linspace(np.log(1e-4), np.log(1e2), 43)
#: Weight of the likelihood shared by all genes, in genes.
PRIOR_GENES = 10.0
ETA = 30.0


#: Rows that share their zero columns in a block of their own; rows whose products are held at once, of so many columns at most.
BLOCK_ROWS, PRODUCT_ROWS, PRODUCT_COLUMNS = 500, 4096, 40


class Blocks:
    """A design as blocks of rows that are zero in the same columns (a type's cells in a condition and sample), without these columns.

    Gram matrices take the square of a block's own columns for each row. They are the dense ones up to rounding.
    """

    def __init__(self, w: np.ndarray):
        self.shape = w.shape
        _, at, n = np.unique(np.packbits(w != 0, axis=1), axis=0, return_inverse=True, return_counts=True)
        at, large = at.ravel(), np.flatnonzero(n >= BLOCK_ROWS)
        order = np.argsort(np.where(np.isin(at, large), at, -1), kind="stable")
        cuts = np.cumsum([len(w) - n[large].sum(), *n[large]])
        self.blocks = []
        for rows in np.split(order, cuts[:-1]):
            cols = np.flatnonzero((w[rows] != 0).any(axis=0))
            if len(rows):
                self.blocks.append((rows, cols, np.ascontiguousarray(w[np.ix_(rows, cols)])))

    def __matmul__(self, a: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0])
        for rows, cols, x in self.blocks:
            out[rows] = x @ a[cols]
        return out

    def weighted(self, r: np.ndarray) -> np.ndarray:
        """w' r"""
        out = np.zeros(self.shape[1])
        for rows, cols, x in self.blocks:
            out[cols] += r[rows] @ x
        return out

    def gram(self, d: np.ndarray) -> np.ndarray:
        """w' diag(d) w"""
        out = np.zeros((self.shape[1], self.shape[1]))
        for rows, cols, x in self.blocks:
            out[np.ix_(cols, cols)] += x.T @ (x * d[rows, None])
        return out

    def grams(self, mu: np.ndarray, psi: np.ndarray) -> np.ndarray:
        """The Gram matrices at working weights mu / (1 + psi mu), one for each psi."""
        p = self.shape[1]
        out = np.zeros((len(psi), p, p))
        for rows, cols, x in self.blocks:
            if len(cols) > PRODUCT_COLUMNS:
                for k, v in enumerate(psi):
                    d = mu[rows] / (1 + v * mu[rows])
                    out[k][np.ix_(cols, cols)] += x.T @ (x * d[:, None])
                continue
            i, j = np.triu_indices(len(cols))
            total = np.zeros((len(psi), len(i)))
            for lo in range(0, len(rows), PRODUCT_ROWS):
                own, m = x[lo : lo + PRODUCT_ROWS], mu[rows[lo : lo + PRODUCT_ROWS]]
                total += (m / (1 + psi[:, None] * m)) @ (own[:, i] * own[:, j])
            full = np.zeros((len(psi), len(cols), len(cols)))
            full[:, i, j] = full[:, j, i] = total
            out[np.ix_(range(len(psi)), cols, cols)] += full
        return out


def blocks(w) -> Blocks:
    return w if isinstance(w, Blocks) else Blocks(w)


class Counts:
    """Counts of one gene; log-gammas are taken of distinct values only."""

    def __init__(self, y: np.ndarray):
        self.y, self.total = y, float(y.sum())
        self.values, self.times = np.unique(y, return_counts=True)
        self.constant = float(lgamma(self.values + 1.0) @ self.times)

    def loglik(self, mu: np.ndarray, psi: float) -> float:
        """Negative binomial log-likelihood at means mu and size 1/psi."""
        r = 1 / psi
        gammas = float((lgamma(self.values + r) - lgamma(np.array(r))) @ self.times)
        return gammas - self.constant - float((r + self.y) @ np.log1p(psi * mu)) + float(self.y @ np.log(np.maximum(mu, 1e-300))) + self.total * float(np.log(psi))


def _penalised(own, mu, psi, a, pen):
    return own.loglik(mu, psi) - 0.5 * float((pen * a * a).sum())


def irls(y: np.ndarray, w: np.ndarray, psi: float, pen: np.ndarray, start: np.ndarray | None = None, maxit: int = 100, tol: float = 1e-12) -> np.ndarray:
    """Coefficients that maximise the NB likelihood (log link) less pen/2 * coefficient^2; steps are halved until it rises."""
    ridge, w = pen + 1e-8, blocks(w)
    if start is None:
        z = np.log(y + 0.5)
        start = np.linalg.solve(w.gram(np.ones(len(y))) + np.diag(ridge), w.weighted(z))
    a = start
    mu = np.exp(np.clip(w @ a, -ETA, ETA))
    own = Counts(y)
    now = _penalised(own, mu, psi, a, ridge)
    for _ in range(maxit):
        d = mu / (1 + psi * mu)
        grad = w.weighted((y - mu) / (1 + psi * mu)) - ridge * a
        step = np.linalg.solve(w.gram(d) + np.diag(ridge), grad)
        scale = 1.0
        for _ in range(30):
            b = a + scale * step
            mu_b = np.exp(np.clip(w @ b, -ETA, ETA))
            new = _penalised(own, mu_b, psi, b, ridge)
            if new >= now - 1e-12 * abs(now):
                break
            scale /= 2
        else:
            break
        a, mu, gain, now = b, mu_b, new - now, new
        if abs(gain) <= tol * (abs(now) + 1) and np.abs(scale * step).max() < 1e-8:
            break
    return a


def profile(y: np.ndarray, w: np.ndarray, mu: np.ndarray, pen: np.ndarray) -> np.ndarray:
    """Cox-Reid adjusted log-likelihood at mu for each dispersion of GRID."""
    own, psi = Counts(y), np.exp(GRID)
    _, det = np.linalg.slogdet(blocks(w).grams(mu, psi) + np.diag(pen + 1e-8))
    return np.array([own.loglik(mu, float(v)) for v in psi]) - 0.5 * det


def peak(curve: np.ndarray) -> float:
    """Dispersion at the top of a curve over GRID, by a parabola through the three best points."""
    k = int(np.argmax(curve))
    if 0 < k < len(GRID) - 1:
        l, c, r = curve[k - 1 : k + 2]
        bend = l - 2 * c + r
        shift = 0.5 * (l - r) / bend if bend < 0 else 0.0
        return float(np.exp(GRID[k] + np.clip(shift, -0.5, 0.5) * (GRID[1] - GRID[0])))
    return float(np.exp(GRID[k]))


def first_dispersion(y: np.ndarray, mu: np.ndarray) -> float:
    """A moment estimate to start from."""
    return float(np.clip(((y - mu) ** 2 - mu).sum() / np.maximum((mu * mu).sum(), 1e-12), 1e-3, 10.0))
