"""Alignment of two tokenizers: which tokens of one lie over which of the other, and how often in the whole corpus.

Both encode the same bytes: a byte-level BPE (A) a space and the text, a SentencePiece model (B) the text, before which it
puts the space itself. Offsets where tokens of both end cut a text into groups; a token of A and one of B that share
bytes are a link. The union of both tokenizers' ends cuts the text into pieces, and each piece is one link.

A pair of ids is packed into an int64, B's id above A's. One pass over the texts stores, for each block of documents, its
segments with their pairs, and for each partition its distinct pairs with partial counts. These are
range-partitioned by B's id, sorted, and summed where equal keys follow each other. A partition of that sort writes its pairs to one
shard, a numpy file in the shared folder, with a mark on the pairs that have the highest count of their B id; the rows that
Spark commits name the files, so what a lost attempt wrote is never read. Then the stored blocks look up their pairs by binary
search in the shards, mapped into memory.

A text is cut into segments at places where both tokenizers always cut: before a space after a visible character,
around a single line end between visible characters, and between a letter or digit and a full stop or comma. A worker aligns
a segment once and remembers it; a document is the sum of its segments.

Results in odd cases: null and empty texts, and texts whose tokens of A or B don't join to the text's bytes, have no tokens: zeros
and an empty `groups`; null and repeated doc_ids are rows of their own; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, small_batches, stored
from .packets import packed, tidy, unpacked
from .segments import _Numbers
from .sentencepiece_bpe import AS_IS, SPACE, _model
from .token_orc import BYTES, _tokenizer, chunk_encoder

#: Documents of a block.
ROWS = 512
#: Beyond so many segments, or so many characters, a worker keeps the LEFT it met most. Bounds memory, not results.
SEGMENTS, CHARACTERS, LEFT = 500_000, 12_000_000, 250_000
#: Rows of a stored file; a block is a row of some megabytes.
FILE_ROWS = 16
#: A longer segment is not kept then.
SHORT = 64
#: A space or line end at which a text can't be cut, or can't be cut on both sides.
_unsafe = re.compile(r"(?<![!-~\w])[ \n]|\n(?![!-~\w])")
_cut = re.compile(r"(?<=[!-~\w])(?= )")
_stops = re.compile(r"(?<![^\W_])[.,]")
#: B's id above A's.
SHIFT = 32


def segments(text: str, lines: bool, stops: bool) -> list[str]:
    """A space and the text, in pieces. lines: whether a line end is a token by itself. stops: whether no token joins a
    letter or digit with a full stop or comma after it."""
    if not lines or _unsafe.search(text):
        return _cut.split(" " + text)
    if stops and not _stops.search(text):
        text = text.replace(".", AS_IS + ".").replace(",", AS_IS + ",")
    return (" " + text).replace(" ", AS_IS + " ").replace("\n", f"{AS_IS}\n{AS_IS}").split(AS_IS)[1:]


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of stretches that follow each other."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


class Aligner:
    """Segments with their groups, written out, and their links as packed pairs."""

    def __init__(self, a_path: str, b_path: str):
        piece, entry = _model(b_path), _tokenizer(a_path, True)
        self.encode_a, self.encode_b = chunk_encoder(a_path, True), piece.encode_words
        self.lines = 10 not in piece.chars
        self.stops = not any(re.search(r"[^\W_][.,]", p) for p in piece.pieces)
        value = {c: b for b, c in enumerate(BYTES)} | {chr(256 + 10): 10}  # the byte-level alphabet; BYTES keeps the line end
        self.bytes_a = [bytes(map(value.get, t)) if t and all(c in value for c in t) else (t or "").encode() for t in map(entry.id_to_token, range(entry.get_vocab_size()))]
        of_byte = {int(i): bytes([b]) for b, i in enumerate(piece.bytes) if i != piece.unknown_id}
        self.bytes_b = [of_byte.get(i) or p.replace(SPACE, " ").encode() for i, p in enumerate(piece.pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        """Everything."""
        self.index, self.characters, self.groups = _Numbers(), 0, []
        self.figures = np.zeros((4, 0), np.int64)  # tokens of A, of B, groups, links
        self.bad, self.used = np.zeros(0, bool), np.zeros(0, np.int64)
        self.pairs, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.index) > SEGMENTS or self.characters > CHARACTERS

    def thin_out(self) -> None:
        """Keeps the segments met most."""
        names = list(self.index)
        keep = np.flatnonzero(np.fromiter(map(len, names), np.int64, len(names)) <= SHORT)
        if len(keep) > LEFT:
            keep = np.sort(keep[np.argpartition(-self.used[keep], LEFT)[:LEFT]])
        names = [names[i] for i in keep.tolist()]
        self.index, self.characters = _Numbers(zip(names, range(len(names)))), sum(map(len, names))
        self.groups = [self.groups[i] for i in keep.tolist()]
        pairs, self.figures = self.pairs_of(keep), self.figures[:, keep]
        self.pairs, self.start = pairs, np.cumsum(self.figures[3]) - self.figures[3]
        self.bad, self.used = self.bad[keep], self.used[keep] // 2

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the segments of all texts, and how many each text has."""
        split = [segments(t, self.lines, self.stops) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        new, self.index.new = self.index.new, []
        if new:
            try:
                self._learn(new)
            except BaseException:
                self.forget()
                raise
        self.used += np.bincount(which, minlength=len(self.used))
        return which, counts

    def _learn(self, new: list[str]) -> None:
        raw, marked = [s.encode() for s in new], [AS_IS + s for s in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        good, sides = np.ones(len(raw), bool), []
        for encode, table, lengths in ((self.encode_a, self.bytes_a, self.length_a), (self.encode_b, self.bytes_b, self.length_b)):
            ids, n = encode(marked)
            joined = b"".join(map(table.__getitem__, ids.tolist()))
            ends = np.cumsum(_sums(lengths[ids], n)).tolist()
            good &= np.fromiter((joined[x:y] == r for x, y, r in zip([0, *ends], ends, raw)), bool, len(raw))
            sides.append((ids.astype(np.int64), n, lengths))
        owned = []
        for ids, n, lengths in sides:
            ids = ids[np.repeat(good, n)]
            owned.append((ids, np.cumsum(lengths[ids])))
        (a, end_a), (b, end_b) = owned
        edge = np.cumsum(size * good)
        # ends of both sides in one order, A's before B's at the same place
        both = np.sort(np.concatenate([end_a * 2, end_b * 2 + 1]), kind="stable")
        place, of_b = both >> 1, both & 1
        last = np.flatnonzero(np.diff(place, append=-1))
        ends, done_b = place[last], np.cumsum(of_b)[last]
        done_a = last + 1 - done_b
        meet = np.diff(last, prepend=-1) == 2
        pairs = b[done_b - (of_b[last] == 1)] << SHIFT | a[done_a - ((of_b[last] == 0) | meet)]
        per = lambda places: np.diff(np.searchsorted(places, edge, "right"), prepend=0)
        links, groups = per(ends), per(ends[meet])
        named = []
        for ids, stop in ((a, done_a[meet].tolist()), (b, done_b[meet].tolist())):
            text = list(map(str, ids.tolist()))
            named.append([text[x] if y - x == 1 else ",".join(text[x:y]) for x, y in zip([0, *stop], stop)])
        written = list(map("|".join, zip(*named)))
        stop = np.cumsum(groups).tolist()
        self.groups += [";".join(written[x:y]) for x, y in zip([0, *stop], stop)]
        self.start = np.concatenate([self.start, len(self.pairs) + np.cumsum(links) - links])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.figures = np.concatenate([self.figures, [sides[0][1] * good, sides[1][1] * good, groups, links]], axis=1)
        self.bad, self.used = np.concatenate([self.bad, ~good]), np.concatenate([self.used, np.zeros(len(raw), np.int64)])
        self.characters += sum(map(len, new))

    def pairs_of(self, some: np.ndarray) -> np.ndarray:
        """Packed pairs of segments, one after the other."""
        n = self.figures[3][some]
        ends = np.cumsum(n)
        return self.pairs[np.repeat(self.start[some] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def counted(self, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the segments and their counts, each segment being used so often."""
        some = np.flatnonzero(uses)
        pairs, times = self.pairs_of(some), np.repeat(uses[some], self.figures[3][some])
        order = np.argsort(pairs, kind="stable")
        keys, first = np.unique(pairs[order], return_index=True)
        return keys, np.add.reduceat(times[order], first) if len(keys) else times


@cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


@cache
def _mapped(uri: str) -> np.ndarray:
    """A shard as a memory map. From a store that can't be mapped, a copy that goes with the process."""
    system, path = _file_system(uri)
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    with tempfile.NamedTemporaryFile() as own:
        with system.open_input_stream(path) as source:
            while part := source.read(1 << 24):
                own.write(part)
        own.flush()
        return np.load(own.name, mmap_mode="r")  # stays mapped when the name is gone


@dataclass(frozen=True)
class Shards:
    """Sorted files of pairs: the first pair of each, and where it is."""

    firsts: tuple[int, ...]
    files: tuple[str, ...]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of sorted keys, and 1 where it is the highest of the B id; zeros for unknown keys."""
        value = np.zeros(len(keys), np.int64)
        cuts = [0, *np.searchsorted(keys, np.array(self.firsts[1:], np.int64)).tolist(), len(keys)]
        for file, x, y in zip(self.files, cuts, cuts[1:]):
            if x < y:
                known, values = _mapped(file)
                at = np.minimum(np.searchsorted(known, keys[x:y]), len(known) - 1)
                value[x:y] = np.where(known[at] == keys[x:y], values[at], 0)
        return value >> 1, value & 1


#: Of a block of documents: its documents, their figures and groups, their segments as numbers within the block, and the
#: segments' pairs. Of a partition: distinct pairs and their counts.
GATHERED = "doc_id array<long>, figures binary, groups array<string>, counts binary, which binary, links binary, pairs binary, distinct binary, n binary"


def gathered(docs: DataFrame, a_path: str, b_path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """Rows of GATHERED, those of blocks with doc_id and those of partitions with distinct pairs."""
    names = [x.split()[0] for x in GATHERED.split(", ")]
    kinds = {"doc_id": pa.list_(pa.int64()), "groups": pa.list_(pa.string())}

    def batch_of(rows: int, **own: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(rows, kinds.get(c, pa.binary())) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, uses = _aligner(a_path, b_path), np.zeros(0, np.int64)

        def counted() -> Iterator[pa.RecordBatch]:
            keys, n = known.counted(uses)
            for at in range(0, len(keys), 1 << 17):
                yield batch_of(1, distinct=pa.array([packed(keys[at : at + (1 << 17)])]), n=pa.array([packed(n[at : at + (1 << 17)])]))

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                which, counts = known.numbers(own.column(1).to_pylist())
                whole = _sums(known.bad[which], counts) == 0
                which, counts = which[np.repeat(whole, counts)], counts * whole
                now = np.bincount(which, minlength=len(known.groups))
                some = np.flatnonzero(now)
                now[: len(uses)] += uses
                uses = now
                order, ends = which.tolist(), np.cumsum(counts).tolist()
                groups = [";".join(map(known.groups.__getitem__, order[x:y])) for x, y in zip([0, *ends], ends)]
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                figures = np.concatenate([_sums(x[which], counts) for x in known.figures])
                within = np.zeros(len(known.groups), np.int32)
                within[some] = np.arange(len(some))
                blobs = {"figures": figures, "counts": counts, "which": within[which], "links": known.figures[3][some].astype(np.int32), "pairs": known.pairs_of(some)}
                one = lambda x: pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), x)
                yield batch_of(1, doc_id=one(own.column(0)), groups=one(pa.array(groups, pa.string())), **{c: pa.array([packed(x)]) for c, x in blobs.items()})
                if known.full():
                    yield from counted()
                    known.thin_out()
                    uses = np.zeros(0, np.int64)
        yield from counted()
        tidy()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, GATHERED)


def _partial(rows: DataFrame) -> DataFrame:
    """(pair, n) of what gathered() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blobs in zip(*batch.to_pydict().values()):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(x, np.int64)) for x in blobs], names=["pair", "n"])

    return rows.where("distinct is not null").select("distinct", "n").mapInArrow(run, "pair long, n long")


def summed(partial: DataFrame, label: str = "pairs") -> Shards:
    """The counts of all pairs as sorted shards in the shared folder. A B id lies within one shard."""
    spark = partial.sparkSession
    folder = fresh_path(spark, label)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n = (batch.column(i).to_numpy() for i in (0, 1))
            first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            key, n = key[first], np.add.reduceat(n, first)
            if keys and keys[-1][-1] == key[0]:  # a run goes on in the next batch
                n[0] += sums[-1][-1]
                keys[-1], sums[-1] = keys[-1][:-1], sums[-1][:-1]
            keys, sums = [x for x in keys if len(x)], [x for x in sums if len(x)]
            keys.append(key)
            sums.append(n)
        if not keys:
            return
        key, n = np.concatenate(keys), np.concatenate(sums)
        owner = key >> SHIFT
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        most = np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(n)))
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.npy"
        with system.open_output_stream(f"{path}/{name}") as out:
            np.lib.format.write_array_header_1_0(out, {"descr": "<i8", "fortran_order": False, "shape": (2, len(key))})
            out.write(key.astype("<i8"))
            out.write((n << 1 | (n == most)).astype("<i8"))
        yield pa.RecordBatch.from_arrays([pa.array([int(key[0])]), pa.array([f"{folder}/{name}"])], names=["first", "file"])

    owner = F.shiftright("pair", SHIFT)
    sorted_ = partial.repartitionByRange(shards, owner).sortWithinPartitions("pair")
    # one row for each shard
    made = sorted(tuple(r) for r in stored(sorted_.mapInArrow(run, "first long, file string"), "shards").collect())
    return Shards(tuple(x for x, _ in made), tuple(x for _, x in made))


def looked_up(blocks: DataFrame, shards: Shards) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of blocks as gathered() gives them."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _aligner.cache_clear()  # what a worker remembers of segments has no more use
        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: batch.column(c)[i] for c in batch.schema.names}
                blob = lambda c, kind: unpacked(own[c].as_py(), kind)
                counts, which, links = blob("counts", np.int64), blob("which", np.int32), blob("links", np.int32).astype(np.int64)
                keys, back = np.unique(blob("pairs", np.int64), return_inverse=True)
                count, best = shards.of(keys)
                found = [_sums(_sums(x[back], links)[which], counts) for x in (best, count)]
                figures = blob("figures", np.int64).reshape(4, -1)
                yield pa.RecordBatch.from_arrays([own["doc_id"].values, *map(pa.array, [*figures, *found]), own["groups"].values], names=names)
        tidy()

    return blocks.mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", groups string")


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for every row of docs: groups written as
    `a1,a2|b1;a3|b2,b3`, or with digest the SHA-256 of that; links counted in all texts of docs."""
    rows = stored(gathered(docs, a_path, b_path, text, digest), "aligned", FILE_ROWS)
    return looked_up(rows.where("distinct is null").drop("distinct", "n"), summed(_partial(rows)))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """(a, b, n): how often two ids are linked in all texts of docs."""
    every = _partial(gathered(docs, a_path, b_path, text, digest=True)).groupBy("pair").agg(F.sum("n").alias("n"))
    return every.select(F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("a"), F.shiftright("pair", SHIFT).cast("int").alias("b"), "n")
