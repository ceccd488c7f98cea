"""Ranked merges of many words at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PLACE = (1 << 32) - 1
#: Of a pair that is not merged.
NONE = 1 << 62


class PairRanks:
    """Pairs of ids (left in the upper 32 bits) -> rank (in the upper bits) and id of what they become."""

    def __init__(self, pairs: dict[int, int]):
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = keys.argsort()
        self.keys, self.values = keys[order], np.fromiter(pairs.values(), np.int64, len(keys))[order]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        if not len(self.keys):
            return np.full(key.shape, NONE)
        at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of equal length (a row of ids each), merged a step of all of them at a time, the leftmost
        of equal ranks first: (rows, their ids) as they end, with ids of equal number."""
        at = np.arange(len(ids))
        ranks = self.of(ids[:, :-1], ids[:, 1:])
        while len(at):
            n, row = ids.shape[1], np.arange(len(at))
            if n == 1:
                yield at, ids
                return
            best = ranks.argmin(axis=1)
            low = ranks[row, best]
            over = low == NONE
            if over.any():
                yield at[over], ids[over]
                go = ~over
                at, ids, ranks, best, low = at[go], ids[go], ranks[go], best[go], low[go]
                row = row[: len(at)]
            # every word loses one id and one pair, so rows stay of one length
            new, kept = low & PLACE, np.ones(ids.shape, bool)
            kept[row, best + 1] = False
            ids = ids[kept].reshape(len(at), n - 1)
            ids[row, best] = new
            kept = np.ones(ranks.shape, bool)
            kept[row, best] = False
            ranks = ranks[kept].reshape(len(at), n - 2)
            i = np.flatnonzero(best > 0)
            ranks[i, best[i] - 1] = self.of(ids[i, best[i] - 1], new[i])
            i = np.flatnonzero(best < n - 2)
            ranks[i, best[i]] = self.of(new[i], ids[i, best[i] + 1])


def merge_words(words: list[bytes], table: PairRanks, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Packed ids (4 bytes each) of each word that is not empty; ``first`` and ``last``: ids of bytes before the end of a word and at it."""
    out = [b""] * len(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        raw = np.frombuffer(b"".join([words[k] for k in at.tolist()]), np.uint8).reshape(-1, n)
        ids = first[raw]
        ids[:, -1] = last[raw[:, -1]]
        for rows, got in table.merge(ids):
            packed, width = got.astype("<i4").tobytes(), 4 * got.shape[1]
            for i, k in enumerate(at[rows].tolist()):
                out[k] = packed[width * i : width * (i + 1)]
    return out
