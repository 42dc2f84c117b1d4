"""Scores and rankings of users from one sorted table of weights. Plain numpy; nothing here knows of Spark.

A user's scores are a sum of weight rows, one per item of the history. They are added up where the history lies, so no
product is ever sent anywhere, and in the order of source items, so they are the same at any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Products that are laid out at once; a longer history is added up in several steps.
STEP_TERMS = 1 << 20
#: A user with fewer products than items over this is scored over the items that get any.
SPARSE_BELOW = 8


def places(names: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Place of each item in the ascending ``names``, -1 for an item that is not there."""
    if not len(names):
        return np.full(len(items), -1, np.int64)
    at = np.searchsorted(names, items)
    at[at == len(names)] = 0
    return np.where(names[at] == items, at, -1)


class WeightTable:
    """Weights by source. Items are places in ``names``, which ascends; so do the sources, and the targets of each."""

    @classmethod
    def of(cls, names: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray) -> WeightTable:
        """The table of weights between the items in ``names``; other weights are left out."""
        s, t = (places(names, x) for x in (source, target))
        keep = (s >= 0) & (t >= 0)
        return cls(names, s[keep], t[keep], weight[keep].astype(np.float64))

    def __init__(self, names: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        order = np.lexsort((target, source))
        self.names, self.n = names, len(names)
        self.start = np.r_[0, np.cumsum(np.bincount(source, minlength=self.n))]
        self.target, self.weight = target[order].astype(np.int32), weight[order]

    def _steps(self, items: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(targets, products) in the order of sources, at most about STEP_TERMS at once."""
        lengths = self.start[items + 1] - self.start[items]
        ends = np.cumsum(lengths)
        lo = 0
        while lo < len(items):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP_TERMS, side="right")))
            n = lengths[lo:hi]
            shift = self.start[items[lo:hi]] - np.r_[0, np.cumsum(n)[:-1]]
            at = np.repeat(shift, n) + np.arange(int(n.sum()))
            yield self.target[at], self.weight[at] * np.repeat(values[lo:hi], n)
            lo = hi

    def _full(self, items: np.ndarray, values: np.ndarray) -> np.ndarray:
        steps = [np.bincount(target, term, self.n) for target, term in self._steps(items, values)]
        return sum(steps[1:], steps[0]) if steps else np.zeros(self.n)

    def _met(self, items: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(targets ascending, scores) of all items that a product falls on."""
        parts = list(self._steps(items, values))
        target = np.concatenate([t for t, _ in parts]) if parts else np.empty(0, np.int32)
        term = np.concatenate([s for _, s in parts]) if parts else np.empty(0)
        met, inverse = np.unique(target, return_inverse=True)
        return met.astype(np.int64), np.bincount(inverse, term, len(met))

    def n_terms(self, items: np.ndarray) -> int:
        return int((self.start[items + 1] - self.start[items]).sum())

    def scores(self, items: np.ndarray, values: np.ndarray, exclude: bool) -> tuple[np.ndarray, np.ndarray]:
        """(items, scores) wherever a history (places ascending) meets a weight; without the history's own items if ``exclude``."""
        if self.n_terms(items) * SPARSE_BELOW < self.n:
            met, total = self._met(items, values)
        else:
            seen = np.zeros(self.n, bool)
            for target, _ in self._steps(items, values):
                seen[target] = True
            met = np.flatnonzero(seen)
            total = self._full(items, values)[met]
        if exclude and len(met):
            keep = ~np.isin(met, items, assume_unique=True)
            met, total = met[keep], total[keep]
        return met, total

    def best(self, items: np.ndarray, values: np.ndarray, k: int, exclude: bool) -> tuple[np.ndarray, np.ndarray]:
        """(items, scores) of the k first: by score, an item without products counting 0 and a seen one -inf; smaller item first among equals."""
        if self.n_terms(items) * SPARSE_BELOW >= self.n:
            total = self._full(items, values)
            if exclude:
                total[items] = -np.inf
            return _first(np.arange(self.n), total, k)
        met, total = self.scores(items, values, exclude)
        some = total != 0
        met, total = met[some], total[some]
        if (total > 0).sum() >= k:
            return _first(met, total, k)
        # some places go to items without score: the smallest of them lie among the first k + |met| + |seen|
        blocked = np.union1d(met, items) if exclude else met
        free = np.setdiff1d(np.arange(min(self.n, k + len(blocked))), blocked, assume_unique=True)[:k]
        rest = [(met, total), (free, np.zeros(len(free)))] + ([(items, np.full(len(items), -np.inf))] if exclude else [])
        return _first(np.concatenate([x for x, _ in rest]), np.concatenate([s for _, s in rest]), k)


def _first(items: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of (items, scores), smaller item first among equals. ``scores`` of equal value may be many."""
    if k < len(scores):
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        level = level[np.argsort(items[level], kind="stable")][: k - len(above)]
        at = np.r_[above, level]
        items, scores = items[at], scores[at]
    order = np.lexsort((items, -scores))
    return items[order], scores[order]
