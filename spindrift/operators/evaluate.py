"""Offline evaluation of rankings: recall, reciprocal rank, nDCG, and a sweep over the fusion constant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import by_shares, places

CUTS = (1, 3, 5, 10)


def per_query(ranked: DataFrame, accepted: DataFrame, **by: list) -> DataFrame:
    """(*by, query_id, recall_1..., rr, ndcg) for every query of accepted (query_id, key) and every value of `by`, whose columns
    `ranked` has. Recall at n: an accepted key is among the first n. nDCG at 10, with gain 1 for an accepted key."""
    good = accepted.distinct()
    base = good.groupBy("query_id").agg(F.count("*").alias("n_good"))
    for name, values in by.items():
        base = base.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    hits = ranked.join(good, ["query_id", "key"])
    gain = F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    found = hits.groupBy(*by, "query_id").agg(F.min("rank").alias("first"), gain.alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_good"), F.lit(10)).cast("int")), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + 1))
    rows = base.join(found, [*by, "query_id"], "left")
    recall = [F.when(F.col("first") <= c, 1.0).otherwise(0.0).alias(f"recall_{c}") for c in CUTS]
    return rows.select(*by, "query_id", *recall, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def _means() -> list:
    return [F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in (*[f"recall_{c}" for c in CUTS], "rr", "ndcg")]]


def summary(scores: DataFrame, *by: str) -> DataFrame:
    """Means of per_query(), by the given columns."""
    return scores.groupBy(*by).agg(*_means())


def by_category(scores: DataFrame, categories: DataFrame, total: str = "all") -> DataFrame:
    """(category, n_queries, means) for queries (query_id, category), and a row for all of them. A query of several
    categories counts in each, and once in the total; one of none is in the total only."""
    named = scores.join(categories.select("query_id", "category").distinct(), "query_id", "left")
    first = F.row_number().over(W.partitionBy("query_id").orderBy("category")) == 1
    # each query once for its category, and its first row once more for the total: one pass over both grouping sets
    both = named.withColumn("in_total", first).withColumn("_set", F.explode(F.when(F.col("in_total"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = both.where((F.col("_set") == 1) | F.col("category").isNotNull())
    return rows.groupBy(F.when(F.col("_set") == 1, F.lit(total)).otherwise(F.col("category")).alias("category"), F.col("_set")).agg(*_means()).drop("_set")


def sweep(arms: dict[str, DataFrame], accepted: DataFrame, constants: list[int], top_k: int = 10) -> DataFrame:
    """summary() for every fusion constant. The arms are placed once, and the constants meet the places."""
    rows = by_shares(places(arms).withColumn("k", F.explode(F.array(*map(F.lit, constants)))), top_k, F.col("k"), "k")
    return summary(per_query(rows, accepted, k=constants), "k")
