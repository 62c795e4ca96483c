"""Packets: sorted 64-bit keys of a block of documents, sent to shards of the key space and answered there.

A table is dealt out in blocks of some hundred documents. A block states each of its distinct keys once, with a
count; the keys go as one packet, a binary value, to every shard of the key space, so that a frequent key costs
a few bytes a block and no shard meets a row for each occurrence. A shard merges its packets, and answers each
with the block's own keys that matter. Both sides of the exchange of texts by block are the same shuffle, which
Spark reuses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a block, about.
BLOCK_DOCS = 700
#: Characters of text for which there is one shard, about.
SHARD_CHARS = 12_000_000


def blocked(docs: DataFrame, blocks: int) -> DataFrame:
    """Docs with the column block. Equal rows are in one block; nothing else decides it but doc_id and text."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64)), F.lit(blocks)))


def extent(docs: DataFrame) -> tuple[int, int]:
    """(blocks, shards) for a table."""
    n, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return max(1, -(-n // BLOCK_DOCS), -(-chars // 4_000_000)), max(1, -(-chars // SHARD_CHARS))


def tidy() -> None:
    """Gives back what Arrow holds of earlier blocks: a worker lives on, and its pool keeps what was freed."""
    pa.default_memory_pool().release_unused()


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, which the shuffle compresses well where the numbers are sorted or small."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def shard_bounds(shards: int, shift: int = 0) -> np.ndarray:
    """The first value of each shard but the first: equal ranges of 64-bit values, shifted right."""
    step = (1 << 64) // shards + 1
    return np.array([(step * i) >> shift for i in range(1, shards)], np.uint64)


def cuts(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where each shard's part of sorted values begins, and the end."""
    return np.concatenate([[0], np.searchsorted(values, bounds), [len(values)]]).astype(np.int64)
