"""Work that writes: registering and syncing documents, refreshing metadata from listings, and embedding what changed.

Each takes a store (sources.store.Store) and commits in batches. A batch holds the documents of a part of the key space; it is one commit,
and its name, with what it counted, is in the manifest that the commit puts in place. Work that stops in the middle keeps
the batches it committed, and when it is started again under the same name it goes on with the others: nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..operators import chunks, sync
from ..sources import openapi, sections
from ..sources.store import KEY, Snapshot, Store

#: Documents of a batch, about.
BATCH_ROWS = 100_000
#: Ids that are broadcast at most, beside the texts they belong to.
BROADCAST_ROWS = 500_000
#: Files that the rows of a batch are dealt to; rows of a file of whole texts at most, where it is read again.
DEALT, FILE_ROWS = 16, 4000
#: Tables whose rows belong to a document.
OWNED = ("documents", "endpoints", "schemas", "sections", "chunks")
DOCUMENTS = "document_id string, project string, source_url string, title string, version string, doc_type string, content_hash string, raw_text string, indexed_at timestamp"


def _part(batches: int, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(KEY).cast("string")), F.lit(batches)) == n


def _dealt(rows: DataFrame, label: str) -> Callable[[int, int], DataFrame]:
    """The rows of each batch, given the number of batches and its own. Rows of several batches are written once, in a folder for each batch:
    if every batch looked for its own in all rows, the work would grow with their square."""
    paths: dict[int, str] = {}

    def part(batches: int, n: int) -> DataFrame:
        if batches == 1:
            return rows
        if batches not in paths:
            paths[batches] = storage.fresh(rows.sparkSession, label)
            # rows of a batch come together in DEALT places, so that a folder has few files
            own = rows.withColumn("_part", F.pmod(F.xxhash64(F.col(KEY).cast("string")), F.lit(batches)))
            own.repartition("_part", F.pmod(F.xxhash64(F.col(KEY).cast("string"), F.lit(1)), F.lit(DEALT))).write.option("compression", "zstd").partitionBy("_part").parquet(paths[batches])
        path = f"{paths[batches]}/_part={n}"
        if not storage.exists(rows.sparkSession, path):
            return rows.sparkSession.createDataFrame([], rows.schema)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    return part


def _batched(store: Store, run: str, rows: int, work: Callable[[Snapshot, int, int], tuple[dict, dict, dict]], batch_rows: int) -> dict:
    """Does the batches of a run that aren't done yet, and adds up what all of its batches counted."""
    known = store.snapshot().log.get(f"{run}/plan")
    if known is None:  # the number of batches is the run's own, however the tables grow until it is started again
        known = {"batches": max(1, -(-rows // batch_rows))}
        store.commit({}, {}, batch=f"{run}/plan", counted=known)
    for n in range(known["batches"]):
        base = store.snapshot()
        if f"{run}/{n}" not in base.log:
            made, replaced, counted = work(base, known["batches"], n)
            store.commit(made, replaced, base, f"{run}/{n}", counted)
    total: dict = {}
    for name, counted in store.snapshot().log.items():
        if name.startswith(f"{run}/") and name != f"{run}/plan":
            for key, value in counted.items():
                total[key] = total.get(key, 0) + value
    return total


def _stored(base: Snapshot, name: str, schema: str) -> DataFrame:
    return base.table(name) if name in base.tables() else base.spark.createDataFrame([], schema)


def parsed(docs: DataFrame, limit: int | None = chunks.TOKEN_LIMIT) -> dict[str, DataFrame]:
    """endpoints, schemas, sections and chunks of routed docs (document_id, text, source_url, doc_type)."""
    specs = docs.where("doc_type = 'openapi'")
    # sections are a table of their own and become chunks: they are made once
    own = {"endpoints": openapi.endpoints(specs), "schemas": openapi.schemas(specs), "sections": storage.kept(sections.sections(docs), "sections", FILE_ROWS)}
    return {**own, "chunks": chunks.build_chunks(own["endpoints"], own["schemas"], own["sections"], limit)}


def outcome(raw: DataFrame, known: DataFrame, owners: DataFrame | None, stored: DataFrame, force: bool = False) -> DataFrame:
    """(document_id, status, content_hash, code, message) for raw documents (document_id, project, source_url, text[, doc_type]): registered,
    reindexed, skipped (the same content, unless forced), or failed, which concerns that document only. known: (document_id, content_hash) of those of
    raw that are stored. owners: (source_url, first), the document of raw that a url falls to, None if raw has no url; one that is stored goes before."""
    hashed = sections.marked(raw).select(KEY, F.trim(F.coalesce("project", F.lit(""))).alias("project"), "source_url", T.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), "message")
    rows = hashed.join(known.groupBy(KEY).agg(F.collect_set("content_hash").alias("known")), KEY, "left")
    taken = F.lit(False)
    if owners is not None:
        owner = stored.where("source_url is not null").select("source_url", F.col(KEY).alias("owner"))
        rows = rows.join(owners, "source_url", "left").join(owner, "source_url", "left")
        taken = F.col("source_url").isNotNull() & (F.coalesce("owner", "first") != F.col(KEY))
    message = F.when((F.col("project") == "") | (F.length("project") > 128), "project must have 1 to 128 characters").when(taken, "source_url is registered already").otherwise(F.col("message"))
    code = F.when((F.col("project") == "") | (F.length("project") > 128), "validation_error").when(taken, "duplicate_document").when(F.col("message").isNotNull(), "parser_error")
    same = F.array_contains("known", F.col("content_hash")) & F.lit(not force)
    status = F.when(code.isNotNull(), "failed").when(F.col("known").isNull(), "registered").when(same, "skipped").otherwise("reindexed")
    return rows.select(KEY, status.alias("status"), "content_hash", code.alias("code"), message.alias("message"))


def ingest(store: Store, raw: DataFrame, run: str, now: datetime, force: bool = False, batch_rows: int = BATCH_ROWS) -> dict:
    """Registers new documents of raw (document_id, project, source_url, text[, doc_type]), one row a document, and syncs known ones. Their endpoints, schemas,
    sections and chunks, and a row of history for every document, come with the same commit. Returns total and a
    count for each status."""

    with_url = raw.where("source_url is not null")
    owners = None if with_url.isEmpty() else with_url.groupBy("source_url").agg(F.min(KEY).alias("first"))
    dealt = _dealt(raw, "raw")
    # a batch changes its own documents only: what is stored of the others' contents it needn't look through
    before = _dealt(_stored(store.snapshot(), "documents", DOCUMENTS).select(KEY, "content_hash"), "known")
    passing: list[DataFrame] = []

    def work(base: Snapshot, batches: int, n: int) -> tuple[dict, dict, dict]:
        storage.freed(*passing)  # of the batch before
        own = dealt(batches, n)
        result = storage.kept(outcome(own, before(batches, n), owners, _stored(base, "documents", DOCUMENTS), force), "outcome")
        counted = {r.status: r.n for r in result.groupBy("status").agg(F.count("*").alias("n")).collect()}
        wanted = result.where("status in ('registered', 'reindexed')").select(KEY)
        # ids are few bytes beside the texts, which then aren't shuffled
        wanted = F.broadcast(wanted) if counted.get("registered", 0) + counted.get("reindexed", 0) <= BROADCAST_ROWS else wanted
        good = storage.kept(sections.routed(own.join(wanted, KEY, "left_semi"))[0], "routed", FILE_ROWS)
        rows = parsed(good)
        specs, texts = good.where("doc_type = 'openapi'"), good.where("doc_type <> 'openapi'")
        titles = sections.markdown_titles(specs.withColumn("title_hint", F.lit(""))).union(openapi.headers(specs).select(KEY, "title"))
        named = titles.groupBy(KEY).agg(F.max_by("title", F.when(F.col("title") == "Untitled Document", 0).otherwise(1)).alias("title"))
        versions = openapi.headers(specs).select(KEY, "version")
        titled = specs.join(named, KEY, "left").join(versions, KEY, "left").unionByName(texts.withColumns({"title": sections.first_heading(F.col("text")), "version": F.lit("")}))
        documents = titled.select(KEY, "project", "source_url", "title", F.coalesce("version", F.lit("")).alias("version"), "doc_type", T.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), F.col("text").alias("raw_text"), F.lit(now).alias("indexed_at"))
        history = result.select(KEY, "status", "content_hash", "code", "message", F.lit(now).alias("created_at"), F.lit(run).alias("run"))
        passing[:] = [result, good, rows["sections"]]
        return {"documents": documents, **rows, "history": history}, {t: good for t in OWNED}, {**counted, "total": sum(counted.values())}

    total = _batched(store, run, raw.count(), work, batch_rows)
    storage.freed(*passing)
    return total


def delete(store: Store, ids: DataFrame, run: str) -> dict:
    """Removes documents (document_id) with all that belongs to them; counts those that weren't there as missing."""

    def work(base: Snapshot, batches: int, n: int) -> tuple[dict, dict, dict]:
        known = _stored(base, "documents", DOCUMENTS).select(KEY)
        asked = ids.select(KEY).distinct()
        there = asked.join(known, KEY, "left_semi")
        removed, all_ = there.count(), asked.count()
        return {}, {t: there for t in OWNED if t in base.tables()}, {"removed": removed, "missing": all_ - removed}

    return _batched(store, run, 1, work, 1)


META = "document_id string, project string, source string, external_id string, title string, url string, modified_at timestamp, indexed_id string, last_synced_at timestamp"


def _meta_id() -> Column:
    return T.stable_id(F.col("source"), F.col("project"), F.col("source"), F.col("external_id").cast("string"))


def refresh(store: Store, listing: DataFrame, run: str, now: datetime, bodies: DataFrame | None = None, batch_rows: int = BATCH_ROWS, fail_at: int | None = None) -> dict:
    """Brings the table `meta` to what a listing (project, source, external_id, ordinal, title, url, modified_at) says, and with bodies
    (document_id, text, status), their sections and chunks too. Only what belongs to a project and source that was listed is removed, with
    its document. A body that can't be read leaves its row as not indexed, so the next run asks for it again; an empty
    one removes the document. Returns synced, added, updated, removed, unchanged and fetched_bodies.

    fail_at: the batch before which an error is raised, for tests."""
    seen = sync.first_seen(listing.where("external_id is not null and cast(external_id as string) <> ''")).withColumn(KEY, _meta_id())
    listed = seen.select("project", "source").distinct()

    def work(base: Snapshot, batches: int, n: int) -> tuple[dict, dict, dict]:
        if n == fail_at:
            raise RuntimeError(f"stopped before batch {n}")
        old = _stored(base, "meta", META).join(listed, ["project", "source"], "left_semi").where(_part(batches, n))
        new = seen.where(_part(batches, n))
        both = old.select(KEY, F.struct("title", "url", "modified_at").alias("old"), "indexed_id").join(new.select(KEY, F.struct("title", "url", "modified_at").alias("new")), KEY, "full_outer")
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
        both = storage.kept(both.withColumn("change", change), "changes")
        gone = both.where("change = 'removed'").select(KEY)
        wanted = both.where("change in ('added', 'updated') or (change = 'unchanged' and indexed_id is null)").select(KEY)
        made: dict = {}
        touched = gone
        state = both.where("change <> 'removed'").select(KEY, "indexed_id")
        fetched = None
        if bodies is not None:
            read = bodies.join(wanted, KEY, "left_semi").where("status = 'ok'").select(KEY, F.coalesce("text", F.lit("")).alias("text"))
            full = F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != ""
            known = _stored(base, "documents", DOCUMENTS).select(KEY, F.col("content_hash").alias("known"))
            read = storage.kept(read.withColumn("content_hash", T.content_hash("text")).join(known, KEY, "left"), "bodies")
            fresh = read.where(full & ~F.col("known").eqNullSafe(F.col("content_hash")))
            typed = fresh.join(new.select(KEY, "project", "source", "title", "url"), KEY).withColumn("doc_type", F.lit("markdown")).withColumn("source_url", F.col("url"))
            own = sections.markdown_sections(typed)
            texts = chunks.build_chunks(openapi.endpoints(typed.where("false")), openapi.schemas(typed.where("false")), own)
            documents = typed.select(KEY, "project", "source_url", "title", F.lit("").alias("version"), F.col("source").alias("doc_type"), "content_hash", F.col("text").alias("raw_text"), F.lit(now).alias("indexed_at"))
            made |= {"documents": documents, "sections": own, "chunks": texts}
            touched = gone.union(fresh.select(KEY)).union(read.where(~full).select(KEY))
            state = state.join(read.select(KEY, F.when(full, F.col(KEY)).alias("_now"), F.lit(True).alias("_read")), KEY, "left").select(KEY, F.when(F.col("_read"), F.col("_now")).otherwise(F.col("indexed_id")).alias("indexed_id"))
            fetched = read
        rows = new.join(state, KEY).select(KEY, "project", "source", F.col("external_id").cast("string").alias("external_id"), "title", "url", "modified_at", F.col("indexed_id").cast("string").alias("indexed_id"), F.lit(now).alias("last_synced_at"))
        counted = {r.change: r.n for r in both.groupBy("change").agg(F.count("*").alias("n")).collect()}
        counted = {x: counted.get(x, 0) for x in ("added", "updated", "removed", "unchanged")} | {"synced": new.count()} | ({"fetched_bodies": fetched.count()} if fetched is not None else {})
        names = [t for t in OWNED if t in base.tables() or t in made]
        return {"meta": rows, **made}, {"meta": both.select(KEY), **{t: touched for t in names}}, counted

    known = store.snapshot()
    return _batched(store, run, max(seen.count(), _stored(known, "meta", META).count()), work, batch_rows)


def pending_embeddings(texts: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """Chunks (document_id, chunk_id, text) without a vector of this text by this model."""
    known = embedded.where(F.col("model") == model).select("chunk_id", "text_hash")
    return texts.withColumn("text_hash", T.content_hash("text")).join(known, ["chunk_id", "text_hash"], "left_anti")


def reembed(store: Store, run: str, model: str, embed: Callable[[DataFrame], DataFrame], batch_rows: int = BATCH_ROWS) -> dict:
    """Embeds the chunks whose text or model has changed, and drops the vectors of chunks that are gone. embed: of
    (chunk_id, text), (chunk_id, embedding); a chunk it leaves out has a null vector. Returns embedded and kept."""
    schema = "document_id string, chunk_id string, text_hash string, model string, embedding array<double>"
    start = store.snapshot()
    # a batch changes vectors of its own documents only, so those of the others are as they were at the start
    dealt = _dealt(start.table("chunks").select(KEY, "chunk_id", "text"), "chunks")
    before = _dealt(_stored(start, "embeddings", schema), "embeddings")

    def work(base: Snapshot, batches: int, n: int) -> tuple[dict, dict, dict]:
        texts = dealt(batches, n)
        old = before(batches, n)
        todo = storage.kept(pending_embeddings(texts, old, model), "pending")
        done = todo.join(embed(todo.select("chunk_id", "text")), "chunk_id", "left").select(KEY, "chunk_id", "text_hash", F.lit(model).alias("model"), F.col("embedding").cast("array<double>").alias("embedding"))
        hashed = texts.select("chunk_id", T.content_hash("text").alias("text_hash"))
        kept = old.where(F.col("model") == model).join(hashed, ["chunk_id", "text_hash"], "left_semi").select(*[x.split(" ")[0] for x in schema.split(", ")])
        # documents with nothing new and nothing gone are left alone
        stale = old.join(kept.select("chunk_id"), "chunk_id", "left_anti").select(KEY).union(todo.select(KEY)).distinct()
        counted = {"embedded": todo.count(), "kept": kept.count()}
        return {"embeddings": done.unionByName(kept.join(stale, KEY, "left_semi"))}, {"embeddings": stale}, counted

    return _batched(store, run, start.table("chunks").count(), work, batch_rows)
