"""The k best per row, kept over a stream of batches: what both search arms do inside a task."""

from __future__ import annotations

import numpy as np
import pandas as pd

CELLS = 1 << 22  # scores that a task holds at a time


class Best:
    """The k best (value falling, then key rising) of each of n rows. Values are compared as they are given."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.floor = np.full(n, -np.inf)  # a value below it is not among the k best of its row
        self.held: list[tuple] = []
        self.waiting = 0

    def add(self, row: np.ndarray, key: np.ndarray, value: np.ndarray) -> None:
        self.held.append((row, key, value))
        self.waiting += len(row)
        if self.waiting > 2 * self.n * self.k:
            self._merge()

    def offer(self, scores: np.ndarray, key: np.ndarray, first: int = 0, digits: int | None = None, least: float = -np.inf) -> None:
        """Takes what may be among the best of a matrix (rows from `first` on, one column a key)."""
        if not scores.size:
            return
        floor = np.maximum(self.floor[first : first + len(scores)], least)
        slack = 0.0 if digits is None else 10.0 ** (1 - digits)
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        row, at = np.nonzero(scores >= floor[:, None] - slack)
        value = scores[row, at]
        self.add(row + first, key[at], value if digits is None else np.round(value, digits))

    def _merge(self) -> None:
        row, key, value = (np.concatenate(x) for x in zip(*self.held))
        place = pd.factorize(key, sort=True)[0]
        order = np.lexsort((place, -value, row))
        row, key, value = row[order], key[order], value[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < self.k
        full = nth == self.k - 1
        self.floor[row[full]] = value[full]
        self.held, self.waiting = [(row[keep], key[keep], value[keep])], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(row, key, value), rows rising; None if nothing was added."""
        if not self.held:
            return None
        self._merge()
        return self.held[0]
