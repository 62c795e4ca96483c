"""Token ids in ORC files: encode, write in document order, read back.

Files hold rows (part, place, doc_id, n, ids) in ascending doc_id order, n being the number of ids. ORC stores the integers run-length
encoded, in stripes with a row index and a Bloom filter on doc_id, so that readers take stripes in parallel
and a lookup by doc_id reads only the stripes and row groups that can hold it. `place` is the number of ids
before the row in its file; with the files' totals it gives every document's place in the whole corpus.

Results in odd cases: a null or empty text is the end id alone; null doc_ids sort first; rows with equal
doc_ids are each kept, in the order of their texts.
"""

from __future__ import annotations

import os
import re
import zlib
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .segments import SegmentIds, with_end

ROWS = 512
#: A space begins a pre-token unless one of these is before it.
_unsafe = re.compile(r" (?<=[^!-~\w] )")
_cut = re.compile(r"(?<=[!-~\w])(?= )")
#: Commas, full stops and line ends that may belong to the pre-token of what is beside them.
_joined = [re.compile(x) for x in (r",(?<=[\W_],) ", r"\.(?<=[\W_]\.)[ \n]", r"\n(?<=\s\n)", r"\n\s")]
#: A lone surrogate can't occur in a text.
AS_IS = "\ud800"
#: The byte-level alphabet: bytes that print stand for themselves, the others for letters from U+0100 on.
_printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
_others = [b for b in range(256) if b not in _printing]
BYTES = "".join(chr(b if b in _printing or b == 10 else 256 + _others.index(b)) for b in range(256))
SCHEMA = "part int, place long, doc_id long, n int, ids array<int>"


@cache
def _tokenizer(path: str, plain: bool):
    """plain: the names of special tokens within a text are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = plain
    return made


@cache
def _special(path: str) -> re.Pattern:
    """The names of special tokens: within a text they are those tokens, as the library has it."""
    names = [re.escape(x.content) for x in _tokenizer(path, False).get_added_tokens_decoder().values()]
    return re.compile("|".join(names) or r"(?!)")


def _chunks(text: str, special: re.Pattern) -> list[str]:
    """Pieces of a text at whose borders no pre-token can lie across. One space before each is left out, but for
    those marked AS_IS."""
    if not text:
        return []
    if special.search(text):
        return [AS_IS + text]
    if text[0] == " " or _unsafe.search(text):
        return [AS_IS + x for x in _cut.split(text) if x]
    text = AS_IS + text
    if not any(x.search(text, 1) for x in _joined):
        # words are met again more often without what stands after them
        text = text.replace(".\n", f" {AS_IS}.\n {AS_IS}").replace(", ", f" {AS_IS}, ").replace(". ", f" {AS_IS}. ")
    return text.split(" ")


def chunk_encoder(path: str, plain: bool = False) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Flat ids of chunks as _chunks() gives them, and how many each has."""
    tokenizer = _tokenizer(path, plain)
    model = tokenizer.model

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chunks = [x[1:] if x[:1] == AS_IS else " " + x for x in chunks]
        # a word, with or without a space before it, is one pre-token: its bytes go to the tokenizer's model as they are
        plain = [x.removeprefix(" ").isalpha() for x in chunks]
        words = charmap_decode("\n".join(compress(chunks, plain)).encode(), "strict", BYTES)[0].split("\n")
        own = ([x.id for x in model.tokenize(w)] for w in words)
        others = iter(tokenizer.encode_batch_fast([x for x, p in zip(chunks, plain) if not p], add_special_tokens=False))
        ids = [next(own) if p else next(others).ids for p in plain]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths

    return encode


@cache
def _encoder(path: str) -> SegmentIds:
    return SegmentIds(chunk_encoder(path))


def encode_sorted(docs: DataFrame, tokenizer_path: str, end_id: int, files: int) -> DataFrame:
    """Rows of SCHEMA, those of each partition in doc_id order."""
    schema = T._parse_datatype_string(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, special, part, place = _encoder(tokenizer_path), _special(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                ids, lengths = known.flat([_chunks(t or "", special) for t in own.column(1).to_pylist()])
                ids, lengths = with_end(ids, lengths, end_id)
                ends = np.cumsum(lengths)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(own.num_rows, part, np.int32)), pa.array(place + ends - lengths), own.column(0), pa.array(lengths.astype(np.int32)), lists],
                    names=["part", "place", "doc_id", "n", "ids"],
                )
                place += int(ends[-1])

    small_batches(docs.sparkSession)
    ranged = docs.select("doc_id", "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    return ranged.mapInArrow(run, schema)


def write_orc(rows: DataFrame, path: str, stripe_mb: int = 16) -> None:
    (
        rows.write.mode("overwrite")
        .option("compression", "zstd")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("orc.row.index.stride", "1000")
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; the filter reaches stripe statistics and Bloom filters."""
    return read_orc(spark, path).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): start is the number of ids of all documents before."""
    rows = read_orc(spark, path)
    total = rows.groupBy("part").agg(F.max(F.col("place") + F.col("n")).alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # one row for each file
    base = total.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, start, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
