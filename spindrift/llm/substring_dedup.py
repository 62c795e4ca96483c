"""Substring dedup: words of windows that also start in a document with a smaller id are removed.

First pass: every block of documents counts its windows in a count-min sketch; the partial sketches are merged
by shard of the cell space, and each block learns which of its cells were hit twice or more. A count-min sketch
never underestimates, so a window that is repeated anywhere is among those. Second pass: only these windows are
grouped exactly (by 96 bits of hash) with the smallest doc_id of each, and a block learns for which of them a
smaller doc_id lies outside. The sketch has a fixed number of cells a shard and grows with the text.

Results in odd cases: null and empty texts have no words and become empty; a document with fewer words than a
window keeps all; rows with equal doc_ids do not remove each other's words; a null doc_id counts as larger than
all others. Within one document a repeated window stays.
"""

from __future__ import annotations

from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashing, packets

#: log2 of the sketch's cells in a shard, and rows of the sketch.
CELL_BITS, DEPTH = 25, 2
LAST = np.iinfo(np.int64).max
_SEEDS = (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of the values, where new values begin in it, and each value's place among the distinct ones."""
    order = np.argsort(values, kind="stable")
    in_order = values[order]
    new = np.ones(len(order), bool)
    new[1:] = in_order[1:] != in_order[:-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, new, place


class _Block:
    """Windows of a block's documents, in the order of the text."""

    def __init__(self, table: pa.Table, k: int):
        packets.tidy()
        self.ids = table.column("doc_id").to_pylist()
        self.words = [hashing.words_of(t, lower=False) for t in table.column("text").to_pylist()]
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.hashes = hashing.WordHashes().of(list(chain.from_iterable(self.words)))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        rolled = hashing.rolling(self.hashes, k)
        #: Where windows begin that lie within one document.
        self.at = np.flatnonzero(doc[k - 1 :] == doc[: len(rolled)]) if len(rolled) else np.zeros(0, np.int64)
        self.window, self.doc, self.k = rolled[self.at], doc[self.at], k

    def cells(self, depth: int, shift: int) -> np.ndarray:
        return hashing.mix(self.window ^ _SEEDS[depth]) >> np.uint64(shift)

    def counted(self, depth: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct cells, and whether two documents or more hit each."""
        values = self.cells(depth, shift)
        order, new, _ = _ranked(values)
        d, first = self.doc[order], np.flatnonzero(new)
        many = np.zeros(len(d), bool)
        many[1:] = ~new[1:] & (d[1:] != d[:-1])
        return values[order[first]], np.logical_or.reduceat(many, first) if len(first) else many

    def suspects(self, answers: pa.Table, shards: int, shift: int) -> np.ndarray:
        """Which windows hit cells of the merged sketch that were hit twice in all rows of it."""
        found = np.ones(len(self.window), bool)
        for depth in range(DEPTH):
            values = self.cells(depth, shift)
            order, new, place = _ranked(values)
            at = packets.cuts(values[order[new]], packets.shard_bounds(shards, shift))
            found &= _bits(answers, depth, at)[place]
        return found

    def groups(self, suspect: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct suspected windows (window, check), sorted, the smallest doc_id of each, and each suspect's place."""
        window, begin = self.window[suspect], self.at[suspect]
        check = np.zeros(len(begin), np.uint64)
        for j in range(self.k):
            check = hashing.mix(check ^ self.hashes[begin + j])
        check = check.astype(np.uint32)
        ids = np.array([LAST if i is None else i for i in self.ids], np.int64)[self.doc[suspect]]
        order = np.lexsort((check, window))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(window[order]) != 0) | (np.diff(check[order]) != 0)
        first = np.flatnonzero(new)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(ids[order], first) if len(first) else ids
        return window[order][first], check[order][first], least, place


def _bits(answers: pa.Table, depth: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(at[-1], bool)
    for d, shard, blob in zip(answers.column("depth").to_pylist(), answers.column("shard").to_pylist(), answers.column("bits").to_pylist()):
        if d == depth:
            a, b = at[shard], at[shard + 1]
            out[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a)
    return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


_PACKET = pa.schema([("depth", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("cells", pa.binary()), ("many", pa.binary())])
_GROUP = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("window", pa.binary()), ("check", pa.binary()), ("least", pa.binary())])
_ANSWER = pa.schema([("depth", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("bits", pa.binary())])
_ANSWER_DDL = "depth int, shard int, block long, bits binary"


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of docs (doc_id, text); text: the words left, joined by one space."""
    docs = docs.select("doc_id", "text")
    blocks, shards = packets.extent(docs)
    shift = max(0, ((1 << 64) // shards).bit_length() - CELL_BITS)
    dealt = packets.blocked(docs, blocks)

    def count(table: pa.Table) -> pa.Table:
        own, rows = _Block(table, window), []
        block = table.column("block")[0].as_py()
        bounds = packets.shard_bounds(shards, shift)
        for depth in range(DEPTH if len(own.window) else 0):
            values, many = own.counted(depth, shift)
            at = packets.cuts(values, bounds)
            low = np.concatenate([[0], bounds]).astype(np.uint64)
            for s in np.flatnonzero(np.diff(at)):
                a, b = at[s], at[s + 1]
                rows.append((depth, int(s), block, packets.packed((values[a:b] - low[s]).astype(np.uint32)), np.packbits(many[a:b]).tobytes()))
        return _table(rows, _PACKET)

    def merge(table: pa.Table) -> pa.Table:
        sketch = np.zeros((1 << CELL_BITS) + 2, np.uint8)
        cells = [packets.unpacked(x, np.uint32) for x in table.column("cells").to_pylist()]
        for own, many in zip(cells, table.column("many").to_pylist()):
            sketch[own] = np.minimum(sketch[own] + 1 + np.unpackbits(np.frombuffer(many, np.uint8), count=len(own)), 2)
        bits = [np.packbits(sketch[own] > 1).tobytes() for own in cells]
        return pa.table([table.column("depth"), table.column("shard"), table.column("block"), pa.array(bits, pa.binary())], schema=_ANSWER)

    def suspect(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _table([], _GROUP)
        own, rows = _Block(table, window), []
        value, check, least, _ = own.groups(own.suspects(answers, shards, shift))
        at = packets.cuts(value, packets.shard_bounds(shards))
        for s in np.flatnonzero(np.diff(at)):
            a, b = at[s], at[s + 1]
            rows.append((int(s), table.column("block")[0].as_py(), packets.packed(value[a:b]), packets.packed(check[a:b]), packets.packed(least[a:b])))
        return _table(rows, _GROUP)

    def settle(table: pa.Table) -> pa.Table:
        parts = [[packets.unpacked(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("window", np.uint64), ("check", np.uint32), ("least", np.int64))]
        value, check, least = map(np.concatenate, parts)
        order = np.lexsort((check, value))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(value[order]) != 0) | (np.diff(check[order]) != 0)
        lowest = np.minimum.reduceat(least[order], np.flatnonzero(new))
        outside = np.empty(len(order), bool)
        outside[order] = lowest[np.cumsum(new) - 1] < least[order]
        ends = np.cumsum([len(x) for x in parts[0]])
        bits = [np.packbits(x).tobytes() for x in np.split(outside, ends[:-1])]
        return pa.table([pa.array(np.full(len(bits), -1, np.int32)), table.column("shard"), table.column("block"), pa.array(bits, pa.binary())], schema=_ANSWER)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Block(table, window)
        starts = np.zeros(len(own.window), bool)
        if len(own.window) and answers.num_rows:
            suspected = own.suspects(answers, shards, shift)
            value, _, least, place = own.groups(suspected)
            outside = _bits(answers, -1, packets.cuts(value, packets.shard_bounds(shards)))
            ids = np.array([LAST if i is None else i for i in own.ids], np.int64)[own.doc[suspected]]
            starts[suspected] = outside[place] | (ids > least[place])
        ends = np.searchsorted(own.doc, np.arange(len(own.words) + 1))
        texts, removed = [], []
        for i, words in enumerate(own.words):
            hit = np.flatnonzero(starts[ends[i] : ends[i + 1]])
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
            keep = np.cumsum(cover[:-1]) == 0
            removed.append(int(len(words) - keep.sum()))
            texts.append((b" ".join(words) if not len(hit) else b" ".join(compress(words, keep))).decode("utf-8"))
        return pa.table([table.column("doc_id"), pa.array([len(w) for w in own.words], pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    by_block = dealt.groupBy("block")
    counted = by_block.applyInArrow(count, "depth int, shard int, block long, cells binary, many binary")
    hits = counted.groupBy("depth", "shard").applyInArrow(merge, _ANSWER_DDL)
    groups = by_block.cogroup(hits.groupBy("block")).applyInArrow(suspect, "shard int, block long, window binary, check binary, least binary")
    outside = groups.groupBy("shard").applyInArrow(settle, _ANSWER_DDL)
    answers = hits.union(outside)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, text string")
