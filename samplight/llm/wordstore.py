"""A bounded store of one vector of numbers for each word."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class WordStore:
    """make(list of words) gives a row each; when the store is full, words met once go."""

    def __init__(self, size: int, width: int, make: Callable[[list[str]], np.ndarray]):
        self.size, self.make = size, make
        self.index: dict[str, int] = {}
        self.values, self.met = np.zeros((0, width), np.float64), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        keep = self.met > 1
        if keep.sum() > self.size // 2:
            keep[:] = False
        row = np.where(keep, np.cumsum(keep) - 1, -1).tolist()
        self.index = {k: row[i] for k, i in self.index.items() if row[i] >= 0}
        self.values, self.met = self.values[keep], self.met[keep]

    def get(self, words: list[str]) -> np.ndarray:
        """The words' rows; words must be distinct."""
        if len(self.index) + len(words) > self.size:
            self._shrink()
        get = self.index.get
        rows = np.array([get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            missing = [words[i] for i in new.tolist()]
            rows[new] = np.arange(len(self.values), len(self.values) + len(missing))
            self.index.update(zip(missing, rows[new].tolist(), strict=True))
            self.values = np.concatenate((self.values, self.make(missing)))
            self.met = np.concatenate((self.met, np.zeros(len(missing), np.int64)))
        self.met[rows] += 1
        return self.values[rows]
