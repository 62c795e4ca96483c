"""Ids of texts put together from ids of their segments. A worker remembers the segments it meets most."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Distinct segments a worker remembers; beyond it, it forgets those it met least. Bounds memory, not results.
REMEMBERED, LEFT = 1_000_000, 500_000


class _Numbers(dict):
    """Numbers the segments it is asked for, and lists the new ones."""

    def __init__(self, *own):
        super().__init__(*own)
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self.new.append(segment)
        number = self[segment] = len(self)
        return number


class SegmentIds:
    """encode(segments) gives, for a list of distinct strings, their flat ids and the number for each."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.index = _Numbers()
        self.pool = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int32)

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        if new:
            flat, lengths = self.encode(new)
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(lengths) - lengths])
            self.pool = np.concatenate([self.pool, flat.astype(np.int32)])
            self.length = np.concatenate([self.length, lengths.astype(np.int32)])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])

    def _forget(self) -> None:
        """Keeps the segments used most, and halves their counts."""
        keep = np.sort(np.argpartition(-self.uses, LEFT)[:LEFT])
        names = list(self.index)  # in the order of their numbers
        lengths = self.length[keep].astype(np.int64)
        ends = np.cumsum(lengths)
        self.pool = self.pool[np.repeat(self.start[keep] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        self.index = _Numbers(zip((names[i] for i in keep.tolist()), range(LEFT)))
        self.start, self.length, self.uses = ends - lengths, lengths.astype(np.int32), self.uses[keep] // 2

    def flat(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each given as its segments, and how many each text has."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        if not len(which):
            return np.zeros(0, np.int32), counts
        try:
            self._learn()
        except BaseException:
            self.__init__(self.encode)
            raise
        self.uses += np.bincount(which, minlength=len(self.uses)).astype(np.int32)
        lengths = self.length[which].astype(np.int64)
        ends = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.start[which] - (ends - lengths), lengths) + np.arange(ends[-1])]
        if len(self.index) > REMEMBERED:
            self._forget()
        text_ends = np.concatenate([[0], ends])[np.cumsum(counts)]
        return ids, np.diff(text_ends, prepend=0)


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Appends end_id to each text's ids."""
    if end_id is None:
        return ids, lengths
    out = np.full(len(ids) + len(lengths), end_id, np.int32)
    own = np.ones(len(out), bool)
    own[np.cumsum(lengths + 1) - 1] = False
    out[own] = ids
    return out, lengths + 1
