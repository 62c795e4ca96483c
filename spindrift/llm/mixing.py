"""Mixing sources to target weights by systematic sampling.

Every source has a target in words. All documents of a source are expected target / size times, so the expected
copies of its first i documents, in order of their sizes, are i times that rate. One offset a source, from 0 to 1, is added, and a
document is taken once for each whole number its stretch crosses: at least the rate rounded down, at most rounded up.
Because the documents stand in order of size, the words taken differ from the target by about the largest
document's size.

A document's place among its source's is found without a window over the source. Documents are counted by source,
bin of sizes and slice of doc_ids; sums over these counts say where a slice begins, and a window within the slice gives
the place in it. There are as many slices as the square root of the largest source's documents, so that neither a
slice nor the slices of a bin become many rows for one task, whatever a source or a size holds.

Only the table of sources, one row for each, is worked on in one task.

Results in odd cases: a null text has size 0; a null source is a source of its own and comes last; null doc_ids come first
within a slice; rows with equal doc_ids are each taken by themselves, equal rows in any order among themselves; an empty table gives no rows;
a source without words has target 0 and its documents are taken 0 times; other columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, stored

#: Bins of sizes for each doubling; below this, a size has its own bin.
BINS = 128


def words(text: Column) -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^" + SPACE_CLASS[1:] + "+")).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Weights go to the sources in order, repeating. The targets are share times all words, by weight, but none is above `most`
    times its source's size: what is above goes to the others by weight until none is above. So a target is the lesser
    of its bound and its weight times one level. In order of bound by weight, the sources at their bounds come first, and
    the level is what these leave over, divided by the weights of the rest."""
    every = W.orderBy(F.col("source").isNull(), "source")
    which = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), which).cast("double")).withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    all_words = F.sum("source_size").over(W.partitionBy(F.lit(0)))
    level = (F.lit(float(share)) * all_words - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # the first source that isn't at its bound sets the level for it and all after it
    level = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("bound"))
    level = level.withColumn("level", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(order))
    return level.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), "bound"), F.col("bound")).alias("target"))


def _bin(size: Column) -> Column:
    """Grows with the size; equal for sizes that differ by less than a BINS-th."""
    power = F.greatest(F.length(F.bin(size)) - F.lit(BINS.bit_length()), F.lit(0))
    return (power * F.lit(BINS) + F.floor(size / F.pow(F.lit(2.0), power))).cast("long")


def offset(seed: int) -> Column:
    """From 0 to 1, by the source's name: 24 bits, so that sums with whole numbers are exact."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 6), 16, 10).cast("double") / F.lit(float(1 << 24))


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs (doc_id, source, text)."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    tie = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    own = stored(docs.select("doc_id", "source", key.alias("key"), words(F.col("text")).alias("size"), tie.alias("tie")), "sizes")
    sizes = stored(own.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs")), "sources")
    slices = max(1, math.ceil(math.sqrt(sizes.agg(F.max("docs")).first()[0] or 0)))
    number = F.conv(F.substring("tie", 1, 8), 16, 10).cast("long") % F.lit(slices)
    placed = own.withColumn("bin", _bin(F.col("size"))).withColumn("slice", number)
    # where a bin of a source begins, and a slice of the bin
    counts = stored(placed.groupBy("key", "bin", "slice").agg(F.count("*").alias("n")), "counts")
    before = lambda *by: F.coalesce(F.sum("n").over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = counts.groupBy("key", "bin").agg(F.sum("n").alias("n")).select("key", "bin", before("key", "bin").alias("bin_start"))
    rates = targets(sizes.select("source", "source_size"), weights, share, most).withColumn("key", key)
    rates = rates.select("key", "source_size", "target", (F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))).alias("rate"), offset(seed).alias("offset"))
    starts = counts.select("key", "bin", "slice", before("key", "bin", "slice").alias("slice_start")).join(bins, ["key", "bin"]).join(rates, "key")
    within = W.partitionBy("key", "bin", "slice").orderBy("size", "doc_id", "tie")
    rows = placed.withColumn("at", F.row_number().over(within)).join(starts, ["key", "bin", "slice"])
    place = F.col("bin_start") + F.col("slice_start") + F.col("at")
    crossed = F.floor(F.col("offset") + F.col("rate") * place) - F.floor(F.col("offset") + F.col("rate") * (place - 1))
    copies = F.coalesce(F.least(crossed, F.ceil("rate")), F.lit(0)).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def drawn(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken. doc_id must be unique."""
    copies = mix(docs, weights, share, most, seed).select("doc_id", "copies").where("copies > 0")
    return docs.join(copies.withColumnRenamed("copies", "_copies"), "doc_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
