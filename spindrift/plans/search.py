"""Whole searches, composed of the arms: endpoints and documents, for a table of queries at once.

Scopes are conditions on columns that the stored indexes carry, and hold before any cut. Results carry what a caller shows. A
key whose row is gone is dropped from the result, and counted on the way by an Observation if one is given:
`seen.get["dangling"]` after the result was read, without a second job. (A global sort of the result reads it twice, and counts twice.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import checked_project, checked_source, checked_top_k
from ..functions import text as T
from ..operators import ranking as R
from ..operators import snippets
from ..operators.indexes import KeywordIndex, TitleIndex
from ..operators.vector_index import VectorIndex

#: Fixed value: the document types that belong to remote sources.
REMOTE_TYPES = ("drive", "notion")


@dataclass(frozen=True)
class Scope:
    """What a search is limited to; None is no limit."""

    project: str | None = None
    document_id: str | None = None
    doc_types: tuple[str, ...] | None = None
    chunk_type: str | None = None

    def where(self, *columns: str) -> Column:
        """The condition, on those of its columns that a table has."""
        limits = {"project": checked_project(self.project), "document_id": self.document_id, "chunk_type": self.chunk_type}
        out = F.lit(True)
        for name, value in limits.items():
            if value is not None and name in columns:
                out = out & (F.col(name) == value)
        return out & F.col("doc_type").isin(*self.doc_types) if self.doc_types is not None and "doc_type" in columns else out


def searchable(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries that can be answered, and the others as (query_id, code, message)."""
    text = F.trim(F.coalesce("text", F.lit("")))
    message = F.when(text == "", "query must not be empty").when(F.size(T.terms("text")) == 0, "query must hold a letter or digit")
    marked = queries.withColumn("message", message)
    return marked.where("message is null").drop("message"), marked.where("message is not null").select("query_id", F.lit("validation_error").alias("code"), "message")


def present(rows: DataFrame, meta: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Rows (key, ...) with the columns of meta (key, ...); rows whose key meta lacks are dropped, and counted."""
    joined = rows.join(meta.withColumn("_there", F.lit(True)), "key", "left")
    if seen is not None:
        joined = joined.observe(seen, F.count_if(F.col("_there").isNull()).alias("dangling"), F.count(F.lit(1)).alias("rows"))
    return joined.where("_there").drop("_there")


def _keyword(index: KeywordIndex | DataFrame, queries: DataFrame, k: int, scope: Scope) -> DataFrame:
    if isinstance(index, KeywordIndex):
        return index.scoped(scope.where(*index.rows.columns)).topk(queries, k)
    return R.keyword_topk(index.where(scope.where(*index.columns)), queries, k)


def _vector(vectors: VectorIndex | DataFrame, asked: DataFrame, k: int, scope: Scope) -> DataFrame:
    if isinstance(vectors, VectorIndex):
        return vectors.topk(asked, k, scope.where(*vectors.rows.columns))
    return R.vector_topk(vectors.where(scope.where(*vectors.columns)), asked, k)


def search_endpoints(queries: DataFrame, endpoints: DataFrame, index: KeywordIndex | DataFrame, vectors: VectorIndex | DataFrame | None, query_vectors: DataFrame | None, top_k: int = 10, strategy: str = "rrf", scope: Scope = Scope(), seen: Observation | None = None) -> DataFrame:
    """(query_id, key, rank, match_type, and the columns of endpoints) for queries (query_id, text[, variants]).

    rrf: exact matches, then the fused keyword and vector arms; variants of a query (of: its id) join the vector arm
    by their best rank. fallback: keyword hits, vector hits only for queries without any (a hit by a variant counts, with score 0). Another name is taken as rrf.
    query_vectors: (query_id, of, embedding)."""
    k = R.width(checked_top_k(top_k))
    own = endpoints.where(scope.where(*endpoints.columns))
    exact = R.exact_matches(own, queries)
    keyword = _keyword(index, queries, k, scope)
    arms = {"keyword": keyword}
    if strategy == "fallback":
        rest = keyword.select("query_id", "key", "rank")
        if vectors is not None and query_vectors is not None:
            rest = R.fallback(rest, _vector(vectors, query_vectors.where("query_id = of"), k, scope).select("query_id", "key", "rank"))
        else:
            rest = rest.withColumn("match_type", F.lit("keyword"))
    else:
        if vectors is not None and query_vectors is not None:
            ranked = _vector(vectors, query_vectors, k, scope).join(query_vectors.select("query_id", "of"), "query_id")
            arms["vector"] = R.best_of_variants(ranked, "of")
        rest = R.fuse(arms, top_k)
    both = R.exact_then_rest(exact, rest, top_k)
    again = W.partitionBy("query_id").orderBy("rank")
    return present(both, own, seen).withColumn("rank", F.row_number().over(again)).select("query_id", "key", "rank", "match_type", *[c for c in own.columns if c != "key"])


def search_documents(queries: DataFrame, titles: TitleIndex, bodies: DataFrame, top_k: int = 10) -> DataFrame:
    """(query_id, key, rank, score) by titles and bodies (key, title, body) for queries (query_id, text[, variants]): title
    candidates, the best of which get their bodies scored."""
    k = R.width(checked_top_k(top_k))
    found = titles.topk(queries, k).join(bodies.select("key", "title", "body"), "key")
    return R.weighted(found, queries, top_k, R.fetch_budget(top_k, k))


def search_indexed(
    queries: DataFrame, titles: TitleIndex, meta: DataFrame, sections: KeywordIndex, owner: DataFrame, vectors: VectorIndex | DataFrame | None = None,
    query_vectors: DataFrame | None = None, top_k: int = 10, source: str | None = None, scope: Scope = Scope(), seen: Observation | None = None,
) -> DataFrame:
    """(query_id, key, rank, score, title, url, source, project, version, winner, snippet, snippet_as_of) of documents for
    queries (query_id, text[, variants]).

    Title, keyword and vector arms over titles and section chunks, folded to documents and fused to the width of an arm; the
    cut to top_k comes after documents without a row in meta (key, title, url, source, project, last_synced_at) and those of another source are gone. owner:
    (chunk, key, text). The winner is the chunk that brought the document in; its snippet is as old as the document's row."""
    k = R.width(checked_top_k(top_k))
    within = scope if checked_source(source) is None else Scope(scope.project, scope.document_id, (source,), scope.chunk_type)
    arms = {"title": titles.topk(queries, k), "keyword": R.fold(_keyword(sections, queries, k, within).select("query_id", "key", "rank"), owner.select("chunk", "key"))}
    if vectors is not None and query_vectors is not None:
        arms["vector"] = R.fold(_vector(vectors, query_vectors, k, within).select("query_id", "key", "rank"), owner.select("chunk", "key"))
    found = present(R.fuse(arms, k), meta, seen)
    if source is not None:
        found = found.where(F.col("source") == source)
    first = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= top_k)
    won = first.join(R.winners(arms), ["query_id", "key"], "left").join(owner.select(F.col("chunk").alias("winner"), "text"), "winner", "left")
    shown = snippets.with_snippets(won.join(queries.select("query_id", F.col("text").alias("query")), "query_id"))
    as_of = F.when(F.col("winner").isNotNull(), F.col("last_synced_at"))
    return shown.select("query_id", "key", "rank", "score", "title", "url", "source", "project", T.version("title").alias("version"), "winner", "snippet", as_of.alias("snippet_as_of"))
