"""A library of documents: one store, what is written to it, and what can be asked of it.

Reads see one version; the indexes are built from that version once, and again only when a newer one is asked for. Whatever takes
queries takes a table of them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import DocumentNotFound, EndpointNotFound, NotConfigured
from ..operators import catalog, sync
from ..operators.indexes import build_keyword_index, build_title_index
from ..operators.vector_index import build_vector_index
from ..sources import mapping
from ..sources.store import KEY, Snapshot, Store
from . import ingest
from .search import REMOTE_TYPES, Scope, search_documents, search_endpoints, search_indexed

_MAPPINGS = "document_id string, project string, source_type string, location string, kind string"


class Library:
    """store: where everything is kept. credentials: (source_type, token). embed: of (chunk_id, text), (chunk_id, embedding); without
    it, there is no vector arm."""

    def __init__(self, store: Store, credentials: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, model: str = "model"):
        self.store, self.credentials, self.embed, self.model = store, credentials, embed, model
        self._indexes: dict[str, object] = {}
        self._of = -1

    # what is written

    def register(self, raw: DataFrame, run: str, now: datetime, force: bool = False) -> dict:
        """Registers or syncs raw documents (document_id, project, source_url, text[, doc_type]); see ingest.ingest."""
        return ingest.ingest(self.store, raw, run, now, force)

    def delete(self, ids: DataFrame, run: str) -> dict:
        return ingest.delete(self.store, ids, run)

    def refresh_index(self, listing: DataFrame, run: str, now: datetime, bodies: DataFrame | None = None, project: str | None = None) -> dict:
        """ingest.refresh() of the listed sources that are mapped and have credentials; NotConfigured if none is."""
        sources = self.sources()
        mapping.require(sources, project, None)
        mapped = sources.select("project", F.col("source_type").alias("source"))
        own = listing if project is None else listing.where(F.col("project") == project)
        done = ingest.refresh(self.store, own.join(mapped, ["project", "source"], "left_semi"), run, now, bodies)
        if bodies is not None and self.embed is not None:
            done["embedded"] = ingest.reembed(self.store, f"{run}:vectors", self.model, self.embed)["embedded"]
        return done

    def reembed(self, run: str) -> dict:
        if self.embed is None:
            raise NotConfigured("no embedding is configured")
        return ingest.reembed(self.store, run, self.model, self.embed)

    def set_mappings(self, fresh: DataFrame) -> None:
        """Registers mappings (project, source_type, location, kind), in place of those that a project and type had."""
        base = self.store.snapshot()
        own = F.concat_ws(":", "project", "source_type")
        rows = mapping.upserted(self.mappings().where("false"), fresh).select(own.alias(KEY), "project", "source_type", "location", "kind")
        self.store.commit({"mappings": rows}, {"mappings": rows.select(KEY)}, base)

    def remove_mappings(self, asked: DataFrame) -> int:
        """Removes the mappings of (project, source_type); the number of those that were there. What was read through them stays."""
        base = self.store.snapshot()
        gone = self.mappings().join(asked, mapping.KEY, "left_semi").select(F.concat_ws(":", *mapping.KEY).alias(KEY))
        n = gone.count()
        if n:
            self.store.commit({}, {"mappings": gone}, base)
        return n

    # what is there

    def _table(self, name: str, schema: str) -> DataFrame:
        now = self.store.snapshot()
        return now.table(name) if name in now.tables() else self.store.spark.createDataFrame([], schema)

    def mappings(self, source_type: str | None = None) -> DataFrame:
        rows = self._table("mappings", _MAPPINGS).select("project", "source_type", "location", "kind")
        return catalog.listed(rows if source_type is None else rows.where(F.col("source_type") == source_type), "mappings")

    def sources(self) -> DataFrame:
        """The mappings that can be read."""
        none = self.store.spark.createDataFrame([], "source_type string, token string")
        return mapping.resolved(self.mappings(), none if self.credentials is None else self.credentials)

    def list_documents(self, project: str | None = None) -> DataFrame:
        now = self.store.snapshot()
        return catalog.list_documents(now.table("documents").drop("raw_text"), now.table("endpoints"), project)

    def history(self, limit: int = 10) -> DataFrame:
        return sync.latest_history(self.store.snapshot().table("history"), limit)

    def list_tags(self, project: str | None = None, document_id: str | None = None) -> DataFrame:
        return catalog.tag_counts(self._endpoints(self.store.snapshot(), Scope(project, document_id)))

    def raw(self, ids: DataFrame) -> DataFrame:
        return catalog.raw_texts(self.store.snapshot().table("documents"), ids)

    def resolve_refs(self, refs: DataFrame) -> DataFrame:
        now = self.store.snapshot()
        return catalog.resolve_refs(refs, now.table("schemas"), now.table("documents"))

    def get_endpoint(self, endpoint_id: str, example: bool = False) -> DataFrame:
        """One endpoint with all its details; EndpointNotFound if there is none."""
        ends = self.store.snapshot().table("endpoints")
        own = ends.where(F.col("endpoint_id") == endpoint_id)
        if own.isEmpty():
            raise EndpointNotFound(f"endpoint not found: {endpoint_id}")
        return catalog.full_details(ends.join(own.select(KEY), KEY, "left_semi"), example=example).where(F.col("endpoint_id") == endpoint_id)

    def get_document(self, source: str, external_id: str) -> DataFrame:
        """(document_id, project, title, url, text) of a remote document, from the newest row of its metadata; DocumentNotFound if there is
        none."""
        now = self.store.snapshot()
        rows = now.table("meta").where((F.col("source") == source) & (F.col("external_id") == external_id)).withColumn("meta_id", F.col(KEY))
        newest = rows.orderBy(F.col("last_synced_at").desc(), "meta_id").limit(1)
        if newest.isEmpty():
            raise DocumentNotFound(f"document not found: {external_id}")
        texts = now.table("documents").select(KEY, F.col("raw_text").alias("text"))
        return newest.join(texts, KEY, "left").select(KEY, "project", "title", "url", F.coalesce("text", F.lit("")).alias("text"))

    # what is found

    def _endpoints(self, now: Snapshot, scope: Scope) -> DataFrame:
        owner = now.table("documents").select(KEY, "project")
        ends = now.table("endpoints").join(owner, KEY)
        return ends.where(scope.where(*ends.columns))

    def _once(self, now: Snapshot, name: str, build: Callable[[], object]):
        if self._of != now.version:
            self._indexes, self._of = {}, now.version
        if name not in self._indexes:
            self._indexes[name] = build()
        return self._indexes[name]

    def _chunks(self, now: Snapshot) -> DataFrame:
        owner = now.table("documents").select(KEY, "project", "doc_type")
        return now.table("chunks").join(owner, KEY)

    def _vectors(self, now: Snapshot, chunk_type: str, key: str):
        if self.embed is None or "embeddings" not in now.tables():
            return None
        own = self._chunks(now).where(F.col("chunk_type") == chunk_type).join(now.table("embeddings").where(F.col("model") == self.model).select("chunk_id", "embedding"), "chunk_id")
        rows = own.select(F.col(key).alias("key"), "embedding", "project", KEY, "doc_type")
        return self._once(now, f"vectors {chunk_type}", lambda: build_vector_index(rows, scope=("project", KEY, "doc_type")))

    def _asked(self, queries: DataFrame) -> DataFrame | None:
        """(query_id, of, embedding) of queries and, numbered after them, their variants."""
        if self.embed is None:
            return None
        texts = queries.select(F.col("query_id").alias("of"), F.concat(F.array("text"), F.col("variants") if "variants" in queries.columns else F.array().cast("array<string>")).alias("all"))
        each = texts.select("of", F.posexplode("all").alias("n", "text")).withColumn("chunk_id", F.concat_ws(":", "of", "n"))
        return each.join(self.embed(each.select("chunk_id", "text")), "chunk_id").select(F.when(F.col("n") == 0, F.col("of").cast("string")).otherwise(F.col("chunk_id")).alias("query_id"), F.col("of").cast("string").alias("of"), "embedding")

    def search_endpoints(self, queries: DataFrame, top_k: int = 10, scope: Scope = Scope(), strategy: str = "rrf", seen: Observation | None = None) -> DataFrame:
        """(query_id, key, rank, match_type, method, path, summary, ...) for queries (query_id, text[, variants]); query_id is a string."""
        now = self.store.snapshot()
        own = self._chunks(now).where("chunk_type = 'endpoint'")
        index = self._once(now, "endpoints", lambda: build_keyword_index(own, "ref_id", scope=("project", KEY, "doc_type")))
        ends = self._endpoints(now, scope).select(F.col("endpoint_id").alias("key"), "method", "path", "operation_id", "summary", KEY, "project")
        asked = queries.withColumn("query_id", F.col("query_id").cast("string"))
        return search_endpoints(asked, ends, index, self._vectors(now, "endpoint", "ref_id"), self._asked(queries), top_k, strategy, scope, seen)

    def search_documents(self, queries: DataFrame, top_k: int = 10, source: str | None = None, project: str | None = None, strategy: str = "indexed", seen: Observation | None = None) -> DataFrame:
        """indexed: search_indexed() over the metadata and the remote documents' sections; fetch: titles, and the stored bodies
        of the best. Queries: (query_id, text[, variants]); query_id is a string."""
        mapping.require(self.sources(), project, source)
        now = self.store.snapshot()
        every = now.table("meta").withColumnRenamed(KEY, "key")
        titles = self._once(now, "titles", lambda: build_title_index(every.select("key", "title", "url")))
        meta = every if project is None else every.where(F.col("project") == project)
        meta = meta if source is None else meta.where(F.col("source") == source)
        if project is not None or source is not None:
            titles = titles.scoped(meta)
        asked = queries.withColumn("query_id", F.col("query_id").cast("string"))
        if strategy != "indexed":
            bodies = meta.select("key", "title").join(now.table("documents").select(F.col(KEY).alias("key"), F.col("raw_text").alias("body")), "key", "left")
            shown = meta.select("key", "url", "source", "project")
            return search_documents(asked, titles, bodies, top_k).join(bodies.select("key", "title"), "key").join(shown, "key")
        own = self._chunks(now).where("chunk_type = 'section'")
        sections = self._once(now, "sections", lambda: build_keyword_index(own, "chunk_id", scope=("project", "doc_type")))
        owner = own.select(F.col("chunk_id").alias("chunk"), F.col(KEY).alias("key"), "text")
        vectors, of = self._vectors(now, "section", "chunk_id"), self._asked(queries)
        return search_indexed(asked, titles, meta, sections, owner, vectors, None if of is None else of.where("query_id = of"), top_k, source, Scope(project, doc_types=REMOTE_TYPES), seen)
