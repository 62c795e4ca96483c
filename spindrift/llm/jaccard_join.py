"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles, as 64-bit hashes. They are XORed into sketches. In a sketch of
bits every shingle flips one bit, so the Hamming distance of two sketches is at most the size of the symmetric
difference of the sets. In a sketch of 64-bit blocks every shingle is XORed into one block, so at most as many
blocks differ. Sets are put into bands of size; in a band whose largest set is M, a pair at the threshold p/q
differs in at most D = 2M(q-p)/(q+p) shingles. The band's sketch has D+1+E blocks, so such a pair has E+1 equal
blocks: documents meet on (band, block, content). A set of which at most E blocks are empty needs no key for those. A set is also
put into the bands up to that of the largest set it can be linked with. Most keys occur once; blocks of documents
send theirs to shards of the key space, sorted and packed, and learn which are shared. Only those become rows.
Candidates whose 1024-bit sketches differ by more than the sizes allow are dropped, the rest are verified on
the sets. Documents with equal sets are one vertex from the start.

Linked groups are found as linking.link says. Within buckets the sizes and the Hamming distance of the 1024-bit
sketches decide what is emitted, and the sets verify it. Of a bucket too large for that, members go on by their
differences from its pivot P: of two that are linked, A and B, at least one of which isn't linked with P, the
differences have an element in common, since |A-P| + |B-P| is more than |A-B| may be. It is one that P lacks, unless
one of the two is smaller than P by about what the other is too far from P. So they meet on one of the first
|A|(q-p)/p + 1 elements of their differences, those that P lacks first.

Results in odd cases: documents without words have no shingles, are linked with nothing and are their own
component; a row with a null doc_id belongs to the component of the documents with an equal set, or to none
(null); rows that repeat a doc_id with different texts are compared as different documents, and one_of_each drops
or keeps each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing, packets
from .common import freed, joined_if_small, stored
from .linking import link

#: Ratio of the largest sizes of neighbouring bands.
BAND_RATIO = 1.5
#: Bits of the sketch by which candidates are dropped.
SKETCH_BITS = 1024
#: Ids of candidates that are broadcast at most (16 bytes each).
BROADCAST_IDS = 1_000_000
#: Pairs whose sets are compared at once at least; of many sets, one for every four.
PAIRS = 5000
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def band_limits(over: int = 1 << 31) -> np.ndarray:
    """The largest size of each band."""
    limits = [1]
    while limits[-1] < over:
        limits.append(max(limits[-1] + 1, int(limits[-1] * BAND_RATIO)))
    return np.array(limits)


def shingle_set(text: str | None, k: int, words: hashing.WordHashes) -> np.ndarray:
    return np.unique(hashing.runs(words.of(hashing.words_of(text, lower=True)), k))


def block_keys(shingles: np.ndarray, band: int, differ: int) -> np.ndarray:
    """The keys of a band's sketch for a set, in a band where linked sets differ in at most `differ` shingles."""
    spare = (differ + 1) // 8 + 1
    blocks = differ + 1 + spare
    block = ((shingles >> np.uint64(16)) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block)
    first = np.flatnonzero(np.diff(block[order], prepend=-1))
    content = np.bitwise_xor.reduceat(hashing.mix(shingles * _ODD)[order], first)
    place = block[order[first]].astype(np.uint64)
    if blocks - len(first) > spare:  # so many are empty that the equal ones may be among those
        empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), place)
        content, place = np.concatenate([content, np.zeros(len(empty), np.uint64)]), np.concatenate([place, empty])
    return hashing.mix(content ^ hashing.mix(place + np.uint64(band << 32)))


def sketch(shingles: np.ndarray) -> np.ndarray:
    flips = np.bincount(((shingles >> np.uint64(8)) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def set_hash(shingles: np.ndarray) -> int | None:
    return int(hashing.signed(hashing.mix(shingles * _ODD).sum(keepdims=True))[0]) if len(shingles) else None


class _Block:
    """Sets, sketches and keys of a block's documents."""

    def __init__(self, table: pa.Table, k: int, p: int, q: int):
        packets.tidy()
        words, limits = hashing.WordHashes(), band_limits()
        self.sizes, self.hashes, self.sketches, keys = [], [], [], []
        for text in table.column("text").to_pylist():
            own = shingle_set(text, k, words)
            self.sizes.append(size := len(own))
            self.hashes.append(set_hash(own))
            self.sketches.append(sketch(own) if size else None)
            found = [own[:0]]
            for band in range(*(np.searchsorted(limits, [size, size * q // p]) + [0, 1])) if size else ():
                if differ := 2 * int(limits[band]) * (q - p) // (q + p):
                    found.append(block_keys(own, band, differ))
            keys.append(np.concatenate(found))
        self.keys = np.concatenate(keys)
        self.doc = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        order = np.argsort(self.keys, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = np.diff(self.keys[order]) != 0
        first = np.flatnonzero(new)
        self.values = self.keys[order[first]]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        #: Whether documents with different sets of this block have the key.
        sets = np.array([h or 0 for h in self.hashes], np.int64)[self.doc[order]]
        apart = np.zeros(len(order), bool)
        apart[1:] = ~new[1:] & (sets[1:] != sets[:-1])
        self.many = np.logical_or.reduceat(apart, first) if len(first) else apart


def sketches(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(doc_id, own, n_shingles, v, sketch, keys); own is the hash of the text, v that of the whole set, null if it is
    empty; keys are those that another document has too."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    blocks, shards = packets.extent(docs)
    by_block = packets.blocked(docs, blocks).groupBy("block")

    def count(table: pa.Table) -> pa.Table:
        own = _Block(table, k, p, q)
        at = packets.cuts(own.values, packets.shard_bounds(shards))
        full = np.flatnonzero(np.diff(at))
        parts = [(at[s], at[s + 1]) for s in full]
        return pa.table(
            [pa.array(full.astype(np.int32)), pa.array([table.column("block")[0].as_py()] * len(full), pa.int64()), pa.array([packets.packed(own.values[a:b]) for a, b in parts], pa.binary()), pa.array([np.packbits(own.many[a:b]).tobytes() for a, b in parts], pa.binary())],
            names=["shard", "block", "keys", "many"],
        )

    def merge(table: pa.Table) -> pa.Table:
        keys = [packets.unpacked(x, np.uint64) for x in table.column("keys").to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(own)) for x, own in zip(table.column("many").to_pylist(), keys)]
        _, which, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = ((n > 1)[which]) | np.concatenate(many).astype(bool)
        bits = [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum([len(x) for x in keys])[:-1])]
        return pa.table([table.column("shard"), table.column("block"), pa.array(bits, pa.binary())], names=["shard", "block", "bits"])

    def give(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Block(table, k, p, q)
        at = packets.cuts(own.values, packets.shard_bounds(shards))
        shared = np.zeros(len(own.values), bool)
        for s, bits in zip(answers.column("shard").to_pylist(), answers.column("bits").to_pylist()):
            shared[at[s] : at[s + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=at[s + 1] - at[s])
        kept = shared[own.place]
        keys = np.split(hashing.signed(own.keys[kept]), np.cumsum(np.bincount(own.doc[kept], minlength=len(own.sizes)))[:-1])
        longs = pa.list_(pa.int64())
        return pa.table(
            [table.column("doc_id"), table.column("own"), pa.array(own.sizes, pa.int64()), pa.array(own.hashes, pa.int64()), pa.array(own.sketches, longs), pa.array(keys, longs)],
            names=["doc_id", "own", "n_shingles", "v", "sketch", "keys"],
        )

    counted = by_block.applyInArrow(count, "shard int, block long, keys binary, many binary")
    answers = counted.groupBy("shard").applyInArrow(merge, "shard int, block long, bits binary")
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(give, "doc_id long, own long, n_shingles long, v long, sketch array<long>, keys array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(v, shingles) of documents that have the column v, where the text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = hashing.WordHashes()
        for batch in batches:
            sets = [shingle_set(t, k, words) for t in batch.column(1).to_pylist()]
            own = [(v, hashing.signed(x)) for v, x in zip(batch.column(0).to_pylist(), sets) if set_hash(x) == v]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in own], pa.int64()), pa.array([x for _, x in own], pa.list_(pa.int64()))], names=["v", "shingles"])

    return docs.select("v", "text").mapInArrow(run, "v long, shingles array<long>")


def cluster(docs: DataFrame, shingle: int = 5, p: int = 8, q: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text): sets of shingles of so many words; documents
    link when q * intersection >= p * union."""
    return _clustered(docs, shingle, p, q).drop("own")


def _clustered(docs: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    docs = docs.select("doc_id", "text")
    signed = stored(sketches(docs, shingle, p, q), "sketches")
    # one of each set: its smallest doc_id stands for it
    classes = stored(signed.where("v is not null").groupBy("v").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min_by("sketch", "doc_id").alias("sketch")), "classes")
    # any row of a class has its keys; only the one of the smallest id gives them
    first = signed.where("size(keys) > 0").join(classes.select("v", "doc_id"), ["v", "doc_id"])
    members = first.select("v", F.explode("keys").alias("key")).distinct()

    def with_sets(pairs: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
        """pairs with n_a, n_b, and added: what the set of a has beyond that of b, and gone: the reverse; the sets, to be freed after that."""
        wanted = stored(pairs.select(F.explode(F.array(a, b)).alias("v")).distinct().join(classes.select("v", "doc_id"), "v"), "wanted")
        texts = joined_if_small(docs, wanted, "doc_id", "inner", wanted.count(), BROADCAST_IDS)
        sets = stored(_sets(texts, shingle).dropDuplicates(["v"]), "sets")
        freed(wanted)
        own = [sets.select(F.col("v").alias(c), F.col("shingles").alias(f"set_{s}")) for c, s in ((a, "a"), (b, "b"))]
        both = pairs.join(own[0], a).join(own[1], b)
        return both.select(a, b, F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), F.array_except("set_a", "set_b").alias("added"), F.array_except("set_b", "set_a").alias("gone")), sets

    bounds = classes.select("v", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_BITS // 64)])

    def near() -> Column:
        """Whether the sizes and the Hamming distance of the sketches, a lower bound of the difference, allow a link."""
        most = (F.col("n_a") + F.col("n_b")) * (q - p)
        differ = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(SKETCH_BITS // 64)), F.lit(0).cast("long"))
        return (F.abs(F.col("n_a") - F.col("n_b")) * (p + q) <= most) & (differ * (p + q) <= most)

    def check(pairs: DataFrame) -> DataFrame:
        shared = F.col("n_a") - F.size("added")
        both, sets = with_sets(pairs, "a", "b")
        # two sets travel with every pair; by parts, their disk is bounded by that of the sets
        parts = max(1, -(-pairs.count() // max(PAIRS, sets.count() // 4)))
        linked = both.where(shared * q >= (F.col("n_a") + F.col("n_b") - shared) * p).select("a", "b")
        linked = [stored(linked.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == part), "links") for part in range(parts)]
        freed(sets)
        return reduce(DataFrame.union, linked)

    def narrow(pairs: DataFrame) -> DataFrame:
        both, sets = with_sets(pairs, "v", "p")
        shared = F.col("n_a") - F.size("added")
        linked = shared * q >= (F.col("n_a") + F.col("n_b") - shared) * p
        #: by how much, times p + q, the difference from the pivot is more than that of a linked set
        excess = (F.size("added") + F.size("gone")) * (p + q) - (F.col("n_a") + F.col("n_b")) * (q - p)
        reach = F.floor(F.col("n_a") * F.lit(q - p) / F.lit(p)).cast("int") + 1
        both = both.select("v", "p", linked.alias("linked"), excess.alias("excess"), (F.col("n_b") - F.col("n_a")).alias("less"), F.slice(F.array_sort("added"), 1, reach).alias("added"), F.slice(F.array_sort("gone"), 1, F.greatest(reach - F.size("added"), F.lit(0))).alias("gone"))
        both = stored(both, "differences")
        freed(sets)
        small = (F.col("less") > 0) | (~F.col("linked") & (F.col("excess") <= 2 * p * F.col("most")))
        keys = F.when(small, F.concat("added", "gone")).otherwise(F.col("added"))
        return both.join(both.groupBy("p").agg(F.max("less").alias("most")), "p").select("v", "p", keys.alias("keys"))

    labels = link(members, bounds, near, check, narrow)
    grouped = classes.join(labels, "v", "left").select("v", "doc_id", F.coalesce("label", "v").alias("label"))
    least = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = grouped.join(least, "label").select("v", "component_id")
    whole = signed.select("doc_id", "own", "n_shingles", "v").join(component, "v", "left")
    out = stored(whole.select("doc_id", "own", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    freed(signed, classes, labels)
    return out


def one_of_each(docs: DataFrame, shingle: int = 5, p: int = 8, q: int = 10) -> DataFrame:
    """Without the documents that are linked, directly or through others, with one of a smaller id."""
    clustered = _clustered(docs, shingle, p, q)
    dropped = stored(clustered.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("own").alias("_own")).distinct(), "dropped")
    freed(clustered)
    same = (docs.doc_id == dropped["_id"]) & (F.xxhash64(docs.text) == dropped["_own"])
    return docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped, same, "left_anti")
