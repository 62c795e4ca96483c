"""SentencePiece encoding and decoding by vectorised merge rounds.

The text is normalised as the model says (white space to U+2581, one put before the text), and cut into words
where a white space follows something else. All distinct words of a batch lie in one flat numpy array of
symbols. A round looks up every neighbouring pair, takes the lowest rank in each word, merges it at its
leftmost place (at all its places where the vocabulary rules out that a merge makes a better pair), and
compacts the array, until no pair remains. Unknown characters become byte pieces.

Results in odd cases: a null or empty text encodes to the end id alone and decodes to the empty text; other
columns pass through; a null list of ids decodes to the empty text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .segments import SegmentIds, with_end

SPACE = "▁"
NONE = np.iinfo(np.int64).max
#: Rows of an Arrow batch worked on at once.
ROWS = 512
#: Longer words are merged one by one: with rounds, a word of n symbols can take n rounds.
LONG = 4096
GONE = -2
#: Marks a word that is taken as it is. A lone surrogate can't occur in a text.
AS_IS = "\ud800"


class PieceModel:
    """Vocabulary of a SentencePiece BPE model with identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(library)
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        self.end_id, self.unknown_id = library.eos_id(), library.unk_id()
        self.bytes = np.full(256, self.unknown_id, np.int64)
        plain: dict[str, int] = {}
        self.control: set[int] = set()
        for i, piece in enumerate(self.pieces):
            if library.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif library.is_control(i):
                self.control.add(i)
            elif not library.is_unknown(i) and not library.is_unused(i):
                plain[piece] = i
        # a byte below 0x80 is a character whatever stands around it
        ascii_of = {int(i): chr(b) for b, i in enumerate(self.bytes[:128]) if i != self.unknown_id}
        self.byte_of = {int(i): b for b, i in enumerate(self.bytes) if b >= 128 and i != self.unknown_id}
        symbols = dict(plain)
        for piece in plain:
            for c in piece:
                symbols.setdefault(c, n + len(symbols))
        self.size = n
        chars = sorted(c for c in symbols if len(c) == 1)
        self.chars = np.array([ord(c) for c in chars], np.int64)
        self.char_symbol = np.array([symbols[c] for c in chars], np.int64)
        scores = np.array([library.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.base = n + len(symbols) + 1
        rows = [
            (symbols[p[:k]] * self.base + symbols[p[k:]], i)
            for p, i in plain.items()
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        ]
        rows.sort()
        self.pair = np.array([r[0] for r in rows], np.int64)
        self.merged = np.array([r[1] for r in rows], np.int64)
        self.pair_of = {k: (int(rank[i]), i) for k, i in rows}
        self.rank = rank[self.merged] if rows else np.zeros(0, np.int64)
        # a piece is safe if no pair that holds it ranks as well as the piece itself
        self.safe = np.ones(self.base, bool)
        for side in (self.pair // self.base, self.pair % self.base):
            real = side < n
            self.safe[side[real][self.rank[real] <= rank[side[real]]]] = False
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain)
        self.cut = re.compile(r"[\s\S]+" if crossing else r" *[^ ]+| +")
        self.fast = not crossing
        self.text_of = [ascii_of[i] if i in ascii_of else " ⁇ " if i == self.unknown_id else "" if i in self.control else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]

    def words(self, text: str) -> list[str]:
        """Segments of a text that no merge can join, white space as U+0020."""
        if not text:
            return []
        text = (" " + text).replace(SPACE, " ")
        if self.fast and "  " not in text and text[-1] != " ":
            return text.split(" ")[1:]
        return [w[1:] if w[0] == " " and w[1:2] not in ("", " ") else AS_IS + w for w in self.cut.findall(text)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words as words() gives them: one white space before each is left out, but for those marked AS_IS."""
        whole = [w[1:] if w[:1] == AS_IS else " " + w for w in words]
        joined = "".join(whole).replace(" ", SPACE)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(whole)), np.fromiter(map(len, whole), np.int64, len(whole)))
        at = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        symbol = np.where(self.chars[at] == code, self.char_symbol[at], -1)
        size = np.bincount(word, minlength=len(whole))
        long = size[word] > LONG
        merged = [self._merge(symbol[~long], word[~long], code[~long])]
        merged += [self._merge_long(symbol[word == w], w, code[word == w]) for w in np.flatnonzero(size > LONG)]
        symbol, word, code = (np.concatenate(x) for x in zip(*merged))
        if len(merged) > 1:
            order = np.argsort(word, kind="stable")
            symbol, word, code = symbol[order], word[order], code[order]
        known = (symbol >= 0) & (symbol < self.size)
        ids, counts = symbol.copy(), np.ones(len(symbol), np.int64)
        if not known.all():
            spelled = {c: chr(c).encode("utf-8", "surrogatepass") for c in np.unique(code[~known]).tolist()}
            counts[~known] = [len(spelled[c]) for c in code[~known].tolist()]
            ids = np.repeat(symbol, counts)
            tail = np.frombuffer(b"".join(spelled[c] for c in code[~known].tolist()), np.uint8)
            ids[np.repeat(~known, counts)] = self.bytes[tail]
        return ids.astype(np.int32), np.bincount(np.repeat(word, counts), minlength=len(whole))

    def _merge(self, symbol: np.ndarray, word: np.ndarray, code: np.ndarray):
        """Merge rounds over flat arrays; finished words leave the arrays."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank = np.full(len(symbol), NONE)
            near = np.flatnonzero((word[1:] == word[:-1]) & (symbol[1:] >= 0) & (symbol[:-1] >= 0))
            key = symbol[near] * self.base + symbol[near + 1]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            hit = self.pair[at] == key
            near, at = near[hit], at[hit]
            rank[near] = self.rank[at]
            into = np.full(len(symbol), -1)
            into[near] = self.merged[at]
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(symbol))
            live = np.repeat(least < NONE, sizes)
            best = live & (rank == np.repeat(least, sizes))
            if not live.all():
                done.append((symbol[~live], word[~live], code[~live]))
            spot = np.flatnonzero(best)
            if not len(spot):
                break
            owner = word[spot]
            first = np.diff(owner, prepend=-1) != 0
            # places of one rank that touch: every second one of a run, from its left end
            run = np.flatnonzero(first | (np.diff(spot, prepend=-2) != 1))
            place = np.arange(len(spot)) - np.repeat(run, np.diff(run, append=len(spot)))
            piece_safe = self.safe[into[spot]]
            all_safe = np.minimum.reduceat(piece_safe, np.flatnonzero(first))
            all_safe = np.repeat(all_safe, np.diff(np.flatnonzero(first), append=len(spot)))
            spot = spot[first | (all_safe & (place % 2 == 0))]
            symbol[spot] = into[spot]
            live[spot + 1] = False
            symbol, word, code = symbol[live], word[live], code[live]
        if not done:
            return symbol, word, code
        parts = [np.concatenate(x) for x in zip(*done)]
        order = np.argsort(parts[1], kind="stable")
        return tuple(x[order] for x in parts)

    def _merge_long(self, symbol: np.ndarray, w: int, code: np.ndarray):
        """One very long word: the same merges in the same order, from a heap of pairs."""
        symbols, n = symbol.tolist(), len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j < n and symbols[i] >= 0 and symbols[j] >= 0 and (hit := self.pair_of.get(symbols[i] * self.base + symbols[j])):
                heapq.heappush(heap, (hit[0], i, symbols[i], symbols[j], hit[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, into = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = into, GONE, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        out = np.array(symbols, np.int64)
        left = out != GONE
        return out[left], np.full(left.sum(), w), code[left]

    def decode(self, ids: list[int]) -> str:
        if not self.byte_of.keys().isdisjoint(ids):
            text = self._decode_bytes(ids)
        else:
            text = "".join(map(self.text_of.__getitem__, ids))
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and first != self.unknown_id and text[:1] == " " else text

    def _decode_bytes(self, ids: list[int]) -> str:
        out, pending = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                pending.append(b)
                continue
            if pending:
                out.append(_utf8(pending))
                pending = bytearray()
            out.append(self.text_of[i])
        return "".join(out) + _utf8(pending)


def _utf8(raw: bytearray) -> str:
    """UTF-8, with U+FFFD for each byte that isn't part of a character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode("utf-8") + "�")
            at += e.start + 1
    return "".join(out)


@cache
def _model(path: str) -> PieceModel:
    return PieceModel(path)


@cache
def _known(path: str) -> SegmentIds:
    return SegmentIds(_model(path).encode_words)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", add_end: bool = True) -> DataFrame:
    """Docs with the column `text` replaced by `ids`, an array of ints (with the model's end id)."""
    keep = [c for c in docs.columns if c not in (text, ids)]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = _model(model_path), _known(model_path)
        for batch in _slices(batches):
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            flat, lengths = known.flat([model.words(t or "") for t in texts])
            flat, lengths = with_end(flat, lengths, model.end_id if add_end else None)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            out = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in keep], out], names=[*keep, ids])

    small_batches(docs.sparkSession)
    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Rows with the text that the column `ids` stands for."""
    keep = [c for c in rows.columns if c != text]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in _slices(batches):
            lists = batch.column(batch.schema.names.index(ids)).to_pylist()
            out = pa.array([model.decode(x or []) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in keep], out], names=[*keep, text])

    return rows.select(*keep).mapInArrow(run, schema)
