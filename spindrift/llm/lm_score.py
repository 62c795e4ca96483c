"""Language-model scores from a weighted backoff automaton of smoothed word n-grams.

Training counts every n-gram of the training documents. The smoothed model is
P1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)) and Pj(w|h) = (c(hw) + m P(w|h')) / (c(h) + m), h' being h without its
first word; it sums to one over the V known words and one unknown. As an automaton: a state is a known history,
it has a weighted arc for every word seen after it, and a failure arc, weight m / (c(h) + m), to the state of
the shorter history. A text is read once from left to right from the empty state: a word that the state has no arc
for takes failure arcs until one has; the arc leads to the longest known history, and the log10 weights of all
arcs taken add up.

No machine holds the automaton. A block of documents states its distinct n-grams with their training counts
once; shards of the key space add them up and answer each block with the totals, that is with the part of the
automaton that the block can reach.

Results in odd cases: a null or empty text is the end token alone; a null doc_id is training data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, packets

END = b"\n"  # no word holds white space
ADD = 0.1
#: Weight of the shorter history, in counts.
BACKOFF = 4.0


class _Block:
    def __init__(self, table: pa.Table, order: int):
        packets.tidy()
        hashes = hashing.WordHashes()
        texts = [[*hashing.words_of(t, lower=True), END] for t in table.column("text").to_pylist()]
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        words = hashes.of([w for t in texts for w in t])
        held = np.array(table.column("held_out").to_pylist(), bool)
        self.training = np.repeat(~held, self.lengths)
        place = np.arange(len(words)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        #: For each order, where it ends: the positions with enough words before, and the key.
        self.at = [np.flatnonzero(place >= j) for j in range(order)]
        self.keys, value = [], np.zeros(len(words), np.uint64)
        for j in range(order):
            # the key of an n-gram is made from its words, first to last
            value = np.full(len(self.at[j]), j + 1, np.uint64)
            for back in range(j, -1, -1):
                value = hashing.mix(value * np.uint64(0x9E3779B97F4A7C15) + words[self.at[j] - back])
            self.keys.append(value)

    def distinct(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        values, which = np.unique(self.keys[j], return_inverse=True)
        return values, which


class _Automaton:
    """The part of the automaton that a block can reach. State 0 is the empty history; the known n-grams that are
    shorter than the order are the others."""

    def __init__(self, own: _Block, totals: list[tuple[np.ndarray, np.ndarray]], n: int, v: int):
        """totals: for each order, the training counts of the block's distinct n-grams, and which of them ends where."""
        order, size = len(totals), len(own.training)
        states, arcs, ends_before = 1, 0, None
        #: For each length of a history, the arc that the word at a place has after it; -1 if there is none.
        self.arc = []
        weights, targets, fails, fail_weights = [], [], [np.zeros(1, np.int64)], [np.zeros(1)]
        for j, (count, which) in enumerate(totals):
            end = np.zeros(len(count), np.int64)
            end[which] = own.at[j]  # a place where the n-gram ends
            ends_at = np.full(size, -1)
            ends_at[own.at[j]] = which
            known = count > 0
            if j == 0:
                suffix = np.zeros(len(count), np.int64)
                chance = (count + ADD) / (n + ADD * (v + 1))
                number = arcs + np.arange(len(count))  # unknown words have an arc as well
            else:
                history, lower = ends_before[end - 1], ends_before[end]
                suffix = own_states[lower]
                chance = (count + BACKOFF * chances[lower]) / (counts[history] + BACKOFF)
                number = np.where(known, arcs + np.arange(len(count)), -1)
            mine = None
            if j < order - 1:
                mine = states + np.arange(len(count))
                states += len(count)
                fails.append(suffix)
                fail_weights.append(np.log10(BACKOFF / (count + BACKOFF)))
            at = np.full(size, -1)
            at[own.at[j]] = number[which]
            self.arc.append(at.tolist())
            arcs += len(count)
            weights.append(np.log10(chance))
            targets.append(suffix if mine is None else np.where(known, mine, 0))
            ends_before, own_states, chances, counts = ends_at, mine, chance, count
        self.weight, self.target = (np.concatenate(x).tolist() for x in (weights, targets))
        self.fail, self.fail_weight = (np.concatenate(x).tolist() for x in (fails, fail_weights))

    def read(self, start: int, end: int) -> float:
        """The log10 probability of the words of a text."""
        arc, weight, target, fail, fail_weight = self.arc, self.weight, self.target, self.fail, self.fail_weight
        state, length, longest, total = 0, 0, len(arc) - 1, 0.0
        for at in range(start, end):
            taken = arc[length][at]
            while taken < 0:
                total += fail_weight[state]
                state = fail[state]
                length -= 1
                taken = arc[length][at]
            total += weight[taken]
            state = target[taken]
            length = min(length + 1, longest) if state else 0
        return total


_ANSWER = "turn int, shard int, block long, totals binary, n long, v long"


def score(docs: DataFrame, order: int = 2, held_out_tenth: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text). Documents
    whose crc32(doc_id) mod 10 is held_out_tenth are not trained on."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == held_out_tenth, F.lit(False))
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    blocks, shards = packets.extent(docs)
    dealt = packets.blocked(docs, blocks)

    def count(table: pa.Table) -> pa.Table:
        own, block = _Block(table, order), table.column("block")[0].as_py()
        turns, shard, keys, counts = [], [], [], []
        bounds = packets.shard_bounds(shards)
        for j in range(order):
            values, which = own.distinct(j)
            seen = np.bincount(which, weights=own.training[own.at[j]], minlength=len(values)).astype(np.uint32)
            at = packets.cuts(values, bounds)
            for s in np.flatnonzero(np.diff(at)):
                a, b = at[s], at[s + 1]
                turns.append(j)
                shard.append(int(s))
                keys.append(packets.packed(values[a:b]))
                counts.append(packets.packed(seen[a:b]))
        return pa.table(
            [pa.array(turns, pa.int32()), pa.array(shard, pa.int32()), pa.array([block] * len(turns), pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
            names=["turn", "shard", "block", "keys", "counts"],
        )

    def add_up(table: pa.Table) -> pa.Table:
        keys = [packets.unpacked(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([packets.unpacked(x, np.uint32) for x in table.column("counts").to_pylist()])
        values, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, weights=counts, minlength=len(values)).astype(np.uint64)
        answers = [packets.packed(x) for x in np.split(total[which], np.cumsum([len(x) for x in keys])[:-1])]
        one = table.column("turn")[0].as_py() == 0
        size = [int(total.sum()) * one, int((total > 0).sum()) * one]
        return pa.table(
            [table.column("turn"), table.column("shard"), table.column("block"), pa.array(answers, pa.binary()), *(pa.array([x] * len(answers), pa.int64()) for x in size)],
            names=["turn", "shard", "block", "totals", "n", "v"],
        )

    def totals(own: _Block, j: int, answers: dict) -> tuple[np.ndarray, np.ndarray]:
        values, which = own.distinct(j)
        at = packets.cuts(values, packets.shard_bounds(shards))
        found = np.zeros(len(values))
        for s in np.flatnonzero(np.diff(at)):
            found[at[s] : at[s + 1]] = packets.unpacked(answers[j, int(s)], np.uint64)
        return found, which

    def read(table: pa.Table, answered: pa.Table) -> pa.Table:
        own = _Block(table, order)
        answers = {(j, s): x for j, s, x in zip(*(answered.column(c).to_pylist() for c in ("turn", "shard", "totals")))}
        n, v = answered.column("all_n")[0].as_py(), answered.column("all_v")[0].as_py()
        found = [totals(own, j, answers) for j in range(order)]
        automaton = _Automaton(own, found, n, v)
        seen = found[0][0][found[0][1]]
        base = np.log10((seen + ADD) / (n + ADD * (v + 1)))
        starts = np.cumsum(own.lengths) - own.lengths
        sums = [np.add.reduceat(x, starts) for x in ((seen > 0).astype(np.int64), base)]
        scores = [automaton.read(a, a + k) for a, k in zip(starts.tolist(), own.lengths.tolist())]
        return pa.table(
            [table.column("doc_id"), table.column("held_out"), pa.array(own.lengths), pa.array(sums[0]), pa.array(np.full(len(starts), n, np.int64)), pa.array(sums[1]), pa.array(scores, pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    by_block = dealt.groupBy("block")
    counted = by_block.applyInArrow(count, "turn int, shard int, block long, keys binary, counts binary")
    answers = counted.groupBy("turn", "shard").applyInArrow(add_up, _ANSWER)
    each = answers.groupBy("turn", "shard").agg(F.first("n").alias("n"), F.first("v").alias("v"))
    whole = each.agg(F.sum("n").alias("all_n"), F.sum("v").alias("all_v"))  # one row
    answered = answers.select("turn", "shard", "block", "totals").join(F.broadcast(whole))
    return by_block.cogroup(answered.groupBy("block")).applyInArrow(
        read, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
