"""Which project reads from which source: rows (project, source_type, location, kind), and what can be asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotConfigured

KEY = ["project", "source_type"]
#: The kinds of a page source, the one that goes first where several are given, and the kind where none is.
KINDS, DEFAULT_KIND = ("page", "database"), "database"


def upserted(mappings: DataFrame, fresh: DataFrame) -> DataFrame:
    """The mappings with those of `fresh` in place of, or beside, what a project and type had; of several fresh rows of one, the first kind, then
    the smallest location."""
    order = F.struct(F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(9)), "location", "kind")
    one = fresh.groupBy(*KEY).agg(F.min(order).alias("x")).select(*KEY, "x.location", "x.kind")
    return mappings.select(*KEY, "location", "kind").join(one.select(*KEY), KEY, "left_anti").unionByName(one)


def seeded(mappings: DataFrame, defaults: DataFrame) -> DataFrame:
    """The mappings, and `defaults` for what has none; seeding twice changes nothing. Defaults without a location are left out."""
    missing = defaults.where("coalesce(location, '') <> ''").join(mappings.select(*KEY), KEY, "left_anti")
    return upserted(mappings, missing)


def resolved(mappings: DataFrame, credentials: DataFrame) -> DataFrame:
    """(project, source_type, location, kind) of the mappings that can be read: those whose type has credentials (source_type, token)
    that aren't empty. A source without a kind has the default one."""
    able = credentials.where("coalesce(token, '') <> ''").select("source_type").distinct()
    kind = F.when(F.col("source_type") == "notion", F.coalesce(F.nullif("kind", F.lit("")), F.lit(DEFAULT_KIND))).otherwise(F.col("kind"))
    return mappings.join(able, "source_type", "left_semi").select(*KEY, "location", kind.alias("kind"))


def answerable(asked: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, project, source) whose sources can be read, and (query_id, code, message) of the others. A query without a project
    asks all; one without a source any. Having no source is an error; finding nothing in one is not."""
    types = sources.groupBy("project").agg(F.collect_set("source_type").alias("own"))
    every = sources.agg(F.collect_set("source_type").alias("any"))  # as many as there are types
    rows = asked.join(types, "project", "left").join(F.broadcast(every), F.lit(True))
    known = F.when(F.col("project").isNull(), F.col("any")).otherwise(F.coalesce("own", F.array().cast("array<string>")))
    message = F.when(F.size(known) == 0, "no document source is configured").when(F.col("source").isNotNull() & ~F.array_contains(known, F.col("source")), F.concat(F.lit("document source is not configured: "), "source"))
    marked = rows.withColumn("message", message)
    return marked.where("message is null").select(*asked.columns), marked.where("message is not null").select("query_id", F.lit(NotConfigured.code).alias("code"), "message")


def require(sources: DataFrame, project: str | None, source: str | None) -> None:
    """Raises NotConfigured if nothing can be read for one query."""
    _, refused = answerable(sources.sparkSession.createDataFrame([(0, project, source)], "query_id int, project string, source string"), sources)
    if rows := refused.collect():
        raise NotConfigured(rows[0].message)
