"""Ranked lexical search by a threshold-seeded join over an index of impacts.

build() reads the documents once. A task gathers its documents into blocks and writes, for each term of a block, one
row with the places, counts and lengths of the documents that hold it, sorted by term, so that a frequent term is as
many rows as there are blocks and no text is shuffled. From these rows each term gets its document frequency, its
weight, and its `depth` largest impacts, an impact being what one occurrence in a query adds to a document's score.

search() answers a table of items. Some k documents have at least the kth impact of any one of an item's terms, so the
largest of these stored impacts, the threshold, is a lower bound of the item's kth score. Of the terms in order of
their largest possible share, those at the end whose shares together stay below the threshold can't lift a
document to it by themselves: only the other terms generate candidates. Within a block, candidates whose partial score and the bound of the
rest miss the threshold (or the block's own kth partial score) go too; what is left is scored exactly, and a block
gives at most k documents an item. All arithmetic on scores is on 64-bit integers, so pruning loses nothing, ties included.

Items meet postings by term, in shards of about SHARD_ITEMS items; a block and a shard are one group. The terms asked for are broadcast if their measured
bytes are at most BROADCAST_BYTES, else both sides are shuffled.

Results in odd cases: null and empty texts and texts without a term hold no term, count nowhere and are never found; a
null doc_id ranks before all others at equal scores; rows with equal doc_ids are documents of their own; equal rows
of items count once, rows of one item_id with different texts are ranked each by itself; items without known terms, and empty tables,
give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, small_batches, stored
from .packets import tidy

#: Fixed value: a term is a run of digits, letters, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for bytes: what isn't part of a term becomes a space, A-Z becomes a-z.
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Words of a block, about; texts looked at at once.
BLOCK_WORDS, ROWS = 1_000_000, 256
SHARD_ITEMS = 1000
BROADCAST_BYTES = 16 << 20
#: Stands for a null doc_id: smaller than all.
NO_ID = np.iinfo(np.int64).min
POSTINGS = "block long, term string, ids array<long>, at array<int>, tf array<int>, n array<int>"
#: Above every impact of a term of weight 1.
_ABOVE = 1 << 20


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Block:
    """Documents whose words are numbered, until there are enough for a block."""

    def __init__(self):
        self.number, self.ids, self.words, self.counts, self.size = _Vocabulary(), [], [], [], 0

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        split = [(t or "").encode().translate(_BYTES).split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        self.words.append(np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int32, int(counts.sum())))
        self.counts.append(counts)
        self.ids.append(ids.fill_null(NO_ID).to_numpy())
        self.size += len(self.words[-1])

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """First the block's documents, then its terms in order."""
        ids, counts, words = np.concatenate(self.ids), np.concatenate(self.counts), np.concatenate(self.words)
        names, docs = sorted(self.number), len(ids)
        rank = np.empty(len(names), np.int64)
        rank[[self.number[w] for w in names]] = np.arange(len(names))
        key, tf = np.unique(rank[words] * docs + np.repeat(np.arange(docs), counts), return_counts=True)
        at, of = key % docs, key // docs
        ends = np.cumsum(np.bincount(of, minlength=len(names)))
        empty = lambda rows, kind: pa.array([None] * rows, pa.list_(kind))
        lists = lambda x: pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(x.astype(np.int32)))
        single = lambda x, kind: pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), pa.array(x.astype(kind)))
        columns = [x.split()[0] for x in POSTINGS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([None], pa.string()), single(ids, np.int64), empty(1, pa.int32()), empty(1, pa.int32()), single(counts, np.int32)], names=columns)
        if names:
            terms = pa.array([w.decode() for w in names], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), block)), terms, empty(len(names), pa.int64()), lists(at), lists(tf), lists(counts[at])], names=columns)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of POSTINGS: a block's documents (term null; ids, n), and its terms (at, tf, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                own = batch.slice(start, ROWS)
                block.add(own.column(0), own.column(1).to_pylist())
                if block.size >= BLOCK_WORDS:
                    yield from block.rows(task << 32 | made)
                    made, block = made + 1, _Block()
        if block.counts:
            yield from block.rows(task << 32 | made)
        tidy()

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, POSTINGS)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and how many each has."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64), np.diff(ends)


def _impact(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What a term of weight 1 adds to the score of a document of n terms."""
    length = 100 - 75 + (75 * n * docs) // words
    return (10**9 * tf) // (1000 * tf + 8 * length)


@dataclass
class Index:
    """postings: as postings() gives them. terms: (term, df, weight, top), top being its largest impacts, the weight included.
    docs, words: documents with at least one term, and all their terms."""

    postings: DataFrame
    terms: DataFrame
    docs: int
    words: int
    depth: int


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 10) -> Index:
    rows = stored(postings(docs, key, text), "postings")
    sizes = rows.where("term is null").select(F.filter("n", lambda x: x > 0).alias("n"))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    blocks, n, words = sizes.agg(F.count("*"), F.coalesce(F.sum(F.size("n")), F.lit(0)), F.coalesce(F.sum(total), F.lit(0))).first()

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf, df = _flat(batch.column(2))
            impact = _impact(tf, _flat(batch.column(3))[0], n, words)
            owner = np.repeat(np.arange(len(df)), df)
            order = np.sort(owner * _ABOVE + (_ABOVE - 1 - impact))
            place = np.arange(len(order)) - np.repeat(np.cumsum(df) - df, df)
            top, kept = (_ABOVE - 1 - order % _ABOVE)[place < depth], np.minimum(df, depth)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32), pa.array(top))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(df), lists], names=["block", "term", "df", "top"])

    own = rows.where("term is not null").select("block", "term", "tf", "n").mapInArrow(largest, "block long, term string, df long, top array<long>")
    # by parts of the blocks first: a frequent term has a row in every block
    parts = max(1, int(blocks**0.5))
    best = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, depth).alias("top")
    some = own.groupBy("term", F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part")).agg(F.sum("df").alias("df"), best)
    every = some.groupBy("term").agg(F.sum("df").alias("df"), best)
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long")
    weighed = every.withColumn("weight", weight).select("term", "df", "weight", F.transform("top", lambda x: x * F.col("weight")).alias("top"))
    return Index(rows, stored(weighed, "terms"), n, words, depth)


def plan(index: Index, items: DataFrame, k: int) -> DataFrame:
    """(q, term, weight, leads, threshold, rest) for every known term of items (q, text): weight includes how often the item has the term;
    leads: whether it generates candidates; rest: what the other terms add at most."""
    if not 1 <= k <= index.depth:
        raise ValueError(f"k must be from 1 to {index.depth}, the impacts that the index stores")
    words = items.select("q", F.explode(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))).alias("term"))
    asked = words.groupBy("q", "term").agg(F.count("*").alias("times")).join(index.terms, "term")
    asked = asked.withColumn("most", F.col("times") * F.get("top", F.lit(0))).withColumn("kth", F.col("times") * F.coalesce(F.get("top", F.lit(k - 1)), F.lit(0)))
    whole = W.partitionBy("q")
    asked = asked.withColumn("threshold", F.max("kth").over(whole)).withColumn("below", F.sum("most").over(whole.orderBy("most", "term").rowsBetween(W.unboundedPreceding, 0)))
    asked = asked.withColumn("leads", F.col("below") >= F.col("threshold"))
    rest = F.sum(F.when(F.col("leads"), 0).otherwise(F.col("most"))).over(whole)
    return asked.select("q", "term", (F.col("times") * F.col("weight")).alias("weight"), "leads", "threshold", rest.alias("rest"))


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by id."""
    found = np.flatnonzero(score > 0)
    if len(found) > k:
        found = found[score[found] >= np.partition(score[found], -k)[-k]]
    return found[np.lexsort((ids[found], -score[found]))[:k]]


def search(index: Index, items: DataFrame, k: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the k documents of highest score above 0 for every row of items."""
    n, words = index.docs, index.words
    named = stored(items.select(F.col(item).alias("item"), F.col(text).alias("text"), F.xxhash64(item, text).alias("q")).distinct(), "items")
    shards = max(1, -(-named.count() // SHARD_ITEMS))
    asks = plan(index, named.select("q", "text"), k).groupBy(F.pmod("q", F.lit(shards)).alias("shard"), "term")
    asks = stored(asks.agg(F.collect_list(F.struct("q", "weight", F.col("leads").cast("long").alias("leads"), "threshold", "rest")).alias("asks")), "asks")
    bytes_ = asks.agg(F.coalesce(F.sum(F.octet_length("term") + 40 * F.size("asks")), F.lit(0))).first()[0]
    known = index.postings.where("term is not null").select("block", "term", "at", "tf", "n")
    met = known.join(F.broadcast(asks) if bytes_ <= BROADCAST_BYTES else asks, "term")
    docs = index.postings.where("term is null").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "ids")
    rows = met.select("shard", "block", "at", "tf", "n", "asks").unionByName(docs, allowMissingColumns=True)

    def ranked(group: pa.Table) -> pa.Table:
        own = group.combine_chunks()
        column = lambda name: own.column(name).chunk(0) if own.column(name).num_chunks else pa.array([], own.schema.field(name).type)
        ids = np.concatenate([x.values.to_numpy() for x in own.column("ids").drop_null().chunks] or [np.zeros(0, np.int64)])
        own = own.filter(column("ids").is_null())
        at, df = _flat(column("at"))
        impact = _impact(_flat(column("tf"))[0], _flat(column("n"))[0], n, words) if len(at) else at
        begin = np.concatenate([[0], np.cumsum(df)])
        per_row = np.diff(column("asks").offsets.to_numpy())
        struct = column("asks").flatten()
        q, weight, leads, threshold, rest = (struct.field(c).to_numpy() for c in ("q", "weight", "leads", "threshold", "rest"))
        of = np.repeat(np.arange(len(df)), per_row)
        order = np.argsort(q, kind="stable")
        firsts = np.flatnonzero(np.diff(q[order], prepend=q[order][0] - 1 if len(q) else 0)) if len(q) else []
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        score = np.zeros(len(ids), np.int64)
        for i, j in zip(firsts, [*firsts[1:], len(q)]):
            mine = order[i:j]
            score[:] = 0
            for x in mine[leads[mine] > 0]:
                a, b = begin[of[x]], begin[of[x] + 1]
                score[at[a:b]] += weight[x] * impact[a:b]
            found = np.flatnonzero(score)
            partial = score[found]
            least = threshold[mine[0]]
            if len(found) > k:
                least = max(least, np.partition(partial, -k)[-k])
            keep = partial + rest[mine[0]] >= least
            found, exact = found[keep], partial[keep]
            for x in mine[leads[mine] == 0]:
                a, b = begin[of[x]], begin[of[x] + 1]
                spot = np.minimum(np.searchsorted(at[a:b], found), b - a - 1)
                hit = at[a:b][spot] == found
                exact[hit] += weight[x] * impact[a:b][spot[hit]]
            top = _best(ids[found], exact, k)
            out.append((int(q[mine[0]]), ids[found[top]], exact[top]))
        lengths = [len(x[1]) for x in out]
        none = [np.zeros(0, np.int64)]
        best = np.concatenate([x[1] for x in out] or none)
        return pa.table([pa.array(np.repeat(np.array([x[0] for x in out], np.int64), lengths)), pa.array(best, mask=best == NO_ID), pa.array(np.concatenate([x[2] for x in out] or none))], names=["q", "doc_id", "score"])

    found = rows.groupBy("shard", "block").applyInArrow(ranked, "q long, doc_id long, score long")
    order = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(named.select("q", "item"), "q").select(F.col("item").alias(item), "rank", "doc_id", "score")
