"""A bounded table from pre-token to token ids, filled by an encoder and read with array operations."""

from __future__ import annotations

from itertools import chain

import numpy as np

#: Pieces kept, and the longest one that is kept.
KEPT, LONGEST = 250_000, 128


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


class PieceTable(dict):
    """piece -> row of `ids`/`first`. `encode_new` maps a list of unseen pieces to all their ids and how many each has.

    The pieces met first stay, up to KEPT; later ones live as long as the batch that needs them.
    """

    def __init__(self, encode_new=None):
        super().__init__()
        self.new = []
        if encode_new:
            self.encode_new = encode_new
        self.ids, self.first, self.used, self.flat = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0, 0

    def __missing__(self, piece):
        self[piece] = row = self.used + len(self.new)
        self.new.append(piece)
        return row

    def _fill(self) -> None:
        flat, sizes = self.encode_new(self.new)
        while len(self.first) < self.used + len(sizes) + 2:
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while len(self.ids) < self.flat + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.flat : self.flat + len(flat)] = flat
        self.first[self.used + 1 : self.used + 1 + len(sizes)] = self.flat + np.cumsum(sizes)
        self.used, self.flat, self.new = self.used + len(sizes), self.flat + len(flat), []

    def rows(self, pieces: list[str]) -> list[int]:
        return list(map(self.__getitem__, pieces))

    def gather(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and how many each text has."""
        was, was_flat = self.used, self.flat
        new = self.new
        if new:
            self._fill()
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum()))
        lo = self.first[at]
        size = self.first[at + 1] - lo
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.ids[np.arange(total) + np.repeat(lo - (stop - size), size)]
        upto = np.concatenate([[0], stop])[np.cumsum(n)] if len(n) else np.zeros(0, np.int64)
        if new and (self.used > KEPT or any(len(p) > LONGEST for p in new)):
            for p in new:
                del self[p]
            self.used, self.flat = was, was_flat
        return ids, np.diff(np.concatenate([[0], upto]))
