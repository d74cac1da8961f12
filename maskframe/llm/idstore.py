"""Token ids by chunk hash, in arrays."""

from __future__ import annotations

import numpy as np


class IdStore:
    """Ids by chunk hash: sorted runs of hashes with slots, and the ids of all slots in one array."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.begin = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for have, slot in self.runs:
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            same = have[at] == keys
            out[same] = slot[at[same]]
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        slot = len(self.begin) - 1 + np.arange(len(keys))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        order = np.argsort(keys)
        self.runs.append((keys[order], slot[order]))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            (a, s), (b, t) = self.runs.pop(), self.runs.pop()
            k, v = np.concatenate([a, b]), np.concatenate([s, t])
            order = np.argsort(k, kind="stable")
            self.runs.append((k[order], v[order]))

    def gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots one after the other, and how many each has."""
        size = self.begin[slot + 1] - self.begin[slot]
        before = np.concatenate([[0], np.cumsum(size)])
        return self.ids[ragged(self.begin[slot], size, before)], size

    def __len__(self) -> int:
        return len(self.begin) - 1


def ragged(begin: np.ndarray, size: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Indexes begin[i] .. begin[i] + size[i] - 1 for all i one after the other."""
    if before is None:
        before = np.concatenate([[0], np.cumsum(size)])
    return np.arange(before[-1]) + np.repeat(begin - before[:-1], size)
