"""An approximate index of vectors: cells around k-means centres, the nearest of which a query reads and ranks exactly.

The centres are fitted on a sample; every vector is indexed. Rows are bucketed by cell and slice: a cell that holds a third of all
vectors is as many parts as there are slices. How many cells a query reads is measured, not guessed: for CALIBRATE vectors the exact
neighbours are found once, and the index reads as many cells as cover RECALL of them. Where vectors have no clusters, that is most cells.
The exact way is ranking.vector_topk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import vectors as V
from . import ranking as R
from .indexes import _slice, _slices, every_slice

#: Rows that the centres are fitted on, at most about, and centres at most: both bound what one task or a broadcast holds.
SAMPLE, CELLS = 50_000, 4096
#: Vectors whose exact neighbours are found, about; the share of these that the cells read must hold; neighbours looked at.
CALIBRATE, RECALL, NEIGHBOURS = 200, 0.97, 10


def _sampled(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About `most` of n rows, the same ones each time."""
    return rows.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // most))) == 0)


def _nearest(rows: DataFrame, centres: np.ndarray, n: int, kept: list[str], unit: str) -> DataFrame:
    """Rows with cells, the numbers of the n centres nearest to the unit vector, the nearest first."""
    fields = [f for f in rows.schema.fields if f.name in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", cells array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array(batch.column(batch.schema.names.index(unit)).to_pylist(), float).reshape(batch.num_rows, -1)
            cells = np.argsort(-(own @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(f.name)) for f in fields], lists], names=[*[f.name for f in fields], "cells"])

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class VectorIndex:
    """rows: (cell, slice, key, u, *scope columns), u being the unit vector."""

    rows: DataFrame
    centres: np.ndarray
    slices: int
    probes: int

    def topk(self, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """(query_id, key, rank, score) for queries (query_id, embedding), approximately; of positive scores only. where: a
        condition on the scope columns, before the cut."""
        if not len(self.centres):
            return self.rows.select(F.lit(0).alias("query_id"), "key", F.lit(0).alias("rank"), F.lit(0.0).alias("score")).where("false")
        asked = queries.where("embedding is not null").select("query_id", V.unit(F.col("embedding")).alias("q"))
        near = _nearest(asked, self.centres, probes or self.probes, ["query_id", "q"], "q").select("query_id", "q", F.explode("cells").alias("cell"))
        rows = self.rows if where is None else self.rows.where(where)
        scored = R.nearest(rows.select("cell", "slice", "key", "u"), every_slice(near, self.slices), ["cell", "slice"], k)
        return R.top(scored, k, F.col("score")).select("query_id", "key", "rank", "score")


def build_vector_index(vectors: DataFrame, scope: tuple[str, ...] = (), path: str | None = None, cells: int | None = None) -> VectorIndex:
    """The index of vectors (key, embedding, *scope), stored under path. Null vectors are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    path = path or storage.fresh(spark, "vector-index")
    units = vectors.where("embedding is not null").select("key", *scope, V.unit(F.col("embedding")).alias("u"))
    n = units.count()
    cells = min(cells or round(n**0.5), CELLS, max(n, 1))
    centres = np.zeros((0, 0))
    if n:
        fitted = KMeans(k=max(2, cells), seed=7, maxIter=10).fit(_sampled(units, n, SAMPLE).select(array_to_vector("u").alias("features")))
        centres = np.array(fitted.clusterCenters())
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        placed = _nearest(units, centres, 1, ["key", *scope, "u"], "u").select(F.get("cells", F.lit(0)).alias("cell"), _slice(_slices(n)), "key", "u", *scope)
    else:
        placed = units.select(F.lit(0).alias("cell"), F.lit(0).alias("slice"), "key", "u", *scope)
    rows = storage.write_bucketed(placed, f"{path}/rows", ["cell", "slice"])
    probes = _measured(rows, centres, n) if n else 1
    storage.put_text(spark, f"{path}/_index", json.dumps({"centres": centres.tolist(), "slices": _slices(n), "probes": probes}))
    return VectorIndex(rows, centres, _slices(n), probes)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    kept = json.loads(storage.get_text(spark, f"{path}/_index"))
    return VectorIndex(storage.open_bucketed(spark, f"{path}/rows"), np.array(kept["centres"]), kept["slices"], kept["probes"])


def _measured(rows: DataFrame, centres: np.ndarray, n: int) -> int:
    """So many cells hold RECALL of the exact neighbours of the calibrating vectors."""
    asked = _sampled(rows, n, CALIBRATE).select(F.col("key").alias("query_id"), F.col("u").alias("embedding"))
    exact = R.vector_topk(rows.select("key", F.col("u").alias("embedding")), asked, NEIGHBOURS).join(rows.select("key", "cell"), "key")
    order = _nearest(asked, centres, len(centres), ["query_id"], "embedding")
    needed = exact.join(order, "query_id").select(F.array_position("cells", F.col("cell")).alias("at"))
    # one row a share: the histogram of places has a row for each cell at most
    return int(needed.agg(F.percentile("at", RECALL)).first()[0] or len(centres)) + 1


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(n_queries, n_expected, n_found, recall) of two rankings (query_id, key)."""
    hit = exact.select("query_id", "key").join(found.select("query_id", "key", F.lit(1).alias("hit")), ["query_id", "key"], "left")
    rows = hit.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_expected"), F.count("hit").alias("n_found"))
    return rows.withColumn("recall", F.col("n_found") / F.col("n_expected"))
