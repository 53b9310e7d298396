"""A generative model of voters, fitted to counts of vote patterns.

A vote is 1 (yes), 0 (no) or None (abstains). Each voter has a chance of each vote in either class. Expectation and
maximisation estimate these and the share of the positive class from the patterns alone; starting values and prior counts
tell which class is which. Voters that agree more than the classes explain are correlated: each counts for less, so that
two copies weigh about as much as one. A crowd of copies that outnumbers all other voters would still pass for the class.

A table of patterns has at most 3^voters rows, whatever the corpus, so the driver may hold it.
"""

from __future__ import annotations

import math

import numpy as np

VOTES = (None, 0, 1)


class LabelModel:
    def __init__(self, prior: float, yes: list[tuple[float, float]], no: list[tuple[float, float]], strength: float = 20.0):
        """prior: share of the positive class. yes, no: for each voter, the chance of (vote 1, vote 0) in either class.

        strength: how many cases these starting values count for in every step.
        """
        self.prior = prior
        self.start = np.array([[[1 - a - b, b, a] for a, b in side] for side in (no, yes)]).clip(1e-4, 1)  # class, voter, vote
        self.start /= self.start.sum(-1, keepdims=True)
        self.table = self.start.copy()
        self.weight = np.ones(len(yes))
        self.correlation = np.eye(len(yes))
        self.strength = strength

    def _index(self, patterns) -> np.ndarray:
        return np.array([[0 if v is None else 1 + v for v in p] for p in patterns], int).reshape(-1, len(self.weight))

    def posterior(self, patterns) -> np.ndarray:
        """Chance of the positive class for each pattern."""
        x = self._index(patterns)
        log = np.log(self.table)
        voters = np.arange(x.shape[1])
        sides = [(log[c][voters, x] * self.weight).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(sides[0] - sides[1] + math.log((1 - self.prior) / self.prior), -50, 50)))

    def _maximise(self, x: np.ndarray, n: np.ndarray, p: np.ndarray) -> None:
        for c, share in ((0, 1 - p), (1, p)):
            for k in range(3):
                self.table[c, :, k] = ((x == k) * (n * share)[:, None]).sum(0)
        self.table += self.strength * self.start
        self.table /= self.table.sum(-1, keepdims=True)
        self.prior = float(np.clip((n * p).sum() / max(n.sum(), 1), 1e-4, 1 - 1e-4))

    def fit(self, patterns, counts, rounds: int = 50) -> "LabelModel":
        """Fits to patterns that occur counts times; none leaves the starting values."""
        x, n = self._index(patterns), np.asarray(counts, float)
        if not n.sum():
            return self
        self._correlate(x, n)
        for _ in range(rounds):
            self._maximise(x, n, self.posterior(patterns))
        return self

    def _correlate(self, x: np.ndarray, n: np.ndarray) -> None:
        """Correlations of yes votes beyond what the class explains; weights that allow for them.

        Were two voters tied by the class alone, their covariance would follow from those with any two others k and l:
        cov(i, k) * cov(j, l) / cov(k, l). The median of that over all k and l is the class's part. It is taken before the
        classes are estimated, as voters that copy each other would else pass for the class.
        """
        yes, w = (x == 2).astype(float), n / n.sum()
        off = yes - (yes * w[:, None]).sum(0)
        cov = (off * w[:, None]).T @ off
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        voters = range(len(sd))
        self.correlation = np.eye(len(sd))
        for i in voters:
            for j in range(i):
                rest = [(k, l) for k in voters for l in voters if len({i, j, k, l}) == 4 and abs(cov[k, l]) > 0.02 * sd[k] * sd[l] and min(sd[k], sd[l]) > 1e-5]
                if rest and min(sd[i], sd[j]) > 1e-5:
                    by_class = float(np.median([cov[i, k] * cov[j, l] / cov[k, l] for k, l in rest]))
                    self.correlation[i, j] = self.correlation[j, i] = float(np.clip((cov[i, j] - by_class) / (sd[i] * sd[j]), -1, 1))
        extra = np.where(self.correlation > 0.2, self.correlation, 0)
        np.fill_diagonal(extra, 0)
        self.weight = 1 / (1 + extra.sum(1))


def logistic(features: np.ndarray, target: np.ndarray, counts: np.ndarray, l2: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Weights of a linear classifier (the last is the intercept) for soft targets, by Newton or gradient steps."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    if not len(x):
        return w
    for _ in range(rounds if x.shape[1] > 400 else 30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - target)) + ridge * w
        if x.shape[1] > 400:
            step = grad / (0.25 * (x.T @ (counts * np.abs(x).sum(1))) + ridge)
        else:
            step = np.linalg.solve((x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w
