"""Incremental synchronisation: a remote listing against what is stored, as set operations over snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["project", "source", "external_id"]


def first_seen(listing: DataFrame, order: str = "ordinal") -> DataFrame:
    """A listing (project, source, external_id, ...) with the first row of each file."""
    return listing.withColumn("_n", F.row_number().over(W.partitionBy(*KEY).orderBy(order))).where("_n = 1").drop("_n")


def diff(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """(project, source, external_id, change): added, updated, unchanged or removed. Rows: (key, title, url, modified_at).
    Only what belongs to a project and source that was listed can be removed."""
    old = stored.select(*KEY, F.struct("title", "url", "modified_at").alias("old"))
    new = listing.select(*KEY, F.struct("title", "url", "modified_at").alias("new"))
    listed = listing.select("project", "source").distinct().withColumn("listed", F.lit(True))
    both = old.join(new, KEY, "full_outer").join(listed, ["project", "source"], "left").where("listed")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return both.select(*KEY, change.alias("change"))


def counters(changes: DataFrame) -> DataFrame:
    return changes.groupBy("project", "source").agg(*[F.count_if(F.col("change") == x).alias(x) for x in ("added", "updated", "removed", "unchanged")])


def merged(stored: DataFrame, listing: DataFrame, now) -> DataFrame:
    """The next snapshot: listed rows with last_synced_at = now, rows of what was not listed as they are, removed ones gone.
    An indexed document_id is kept."""
    known = stored.select(*KEY, "document_id")
    listed = listing.select("project", "source").distinct()
    fresh = listing.select(*KEY, "title", "url", "modified_at").join(known, KEY, "left").withColumn("last_synced_at", now)
    rest = stored.join(listed, ["project", "source"], "left_anti").select(*fresh.columns)
    return fresh.unionByName(rest)


def needs_body(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys whose bodies are to be read: added and updated ones, and those never indexed."""
    pending = stored.where("document_id is null").select(*KEY)
    changed = changes.where(F.col("change").isin("added", "updated")).select(*KEY)
    kept = changes.where("change <> 'removed'").select(*KEY)
    return changed.union(pending.join(kept, KEY, "left_semi")).distinct()


def body_actions(bodies: DataFrame, documents: DataFrame, force: bool = False) -> DataFrame:
    """(document_id, content_hash, action) of read bodies (document_id, text, status): index, skip (same content), clear (empty), or failed. A
    failure concerns its own row only; every body is one row, also where an id is stored or read more than once."""
    text = F.coalesce("text", F.lit(""))
    hashed = bodies.select("document_id", (~text.rlike(r"(?U)\S")).alias("empty"), "status", F.sha2(text, 256).alias("content_hash"))
    known = documents.select("document_id", "content_hash").distinct().withColumn("known", F.lit(True))
    action = (
        F.when(F.col("status") != "ok", "failed")
        .when(F.col("empty"), "clear")
        .when(F.coalesce("known", F.lit(False)) & F.lit(not force), "skip")
        .otherwise("index")
    )
    return hashed.join(known, ["document_id", "content_hash"], "left").select("document_id", "content_hash", action.alias("action"))


def resync_summary(actions: DataFrame) -> DataFrame:
    """(total, reindexed, skipped, failed) of actions (document_id, action); failures() has which ones failed."""
    counts = {"reindexed": "index", "skipped": "skip", "failed": "failed"}
    return actions.agg(F.count("*").alias("total"), *[F.count_if(F.col("action") == x).alias(c) for c, x in counts.items()])


def failures(actions: DataFrame) -> DataFrame:
    """A row for every document that failed."""
    return actions.where("action = 'failed'").select("document_id")


def cascade(removed: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows of removed keys."""
    gone = removed.select(key).distinct()
    return [t.join(gone, key, "left_anti") for t in tables]


def replaced(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The table with the rows of every key in `fresh` replaced by those."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def latest_history(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The newest rows of each document's history (document_id, created_at, ...), the newest first."""
    order = W.partitionBy("document_id").orderBy(F.col("created_at").desc(), "content_hash")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def history(past: DataFrame, actions: DataFrame, now) -> DataFrame:
    """Sync history with a row for every action added."""
    return past.unionByName(actions.select("document_id", "action", "content_hash", now.alias("created_at")))
