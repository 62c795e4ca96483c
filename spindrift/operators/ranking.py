"""Arms of hybrid retrieval, and their fusion. Every operator answers a whole table of queries at once.

Queries are rows (query_id, ...); an arm gives (query_id, key, rank, score); ties go to the smaller key. Scores
are ranked rounded to nine digits, so that the order of summation can't change a rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

RRF_K = 60
#: Saturation of a term's count in the keyword score.
SATURATION = 1.2
#: Bytes of queries that are broadcast at most. A larger table of queries is shuffled.
BROADCAST_BYTES = 32 << 20
#: Vectors, or queries, of a block; scores of a block that are held at once.
BLOCK_ROWS, BLOCK_SCORES = 1 << 15, 1 << 22


def width(top_k: int) -> int:
    """Candidates an arm gives for top_k results."""
    return max(4 * top_k, 50)


def fetch_budget(top_k: int, n: int) -> int:
    """Bodies read for top_k results out of n candidates."""
    return min(max(top_k, min(3 * top_k, 20)), n)


def bounded(queries: DataFrame) -> DataFrame:
    """Queries, marked for broadcast if their measured texts and lists are few bytes."""
    size = sum((F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) for f in queries.schema.fields), F.lit(16))
    return F.broadcast(queries) if (queries.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else queries


def top(rows: DataFrame, k: int, score: Column, key: str = "key", by: str = "query_id") -> DataFrame:
    """Rows with their rank within a query, the k best."""
    ordered = W.partitionBy(by).orderBy(F.round(score, 9).desc(), F.col(key))
    return rows.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf). Stored bucketed by term, this is the index of the keyword arm."""
    return docs.select(F.col(key).alias("key"), F.explode(T.terms(text)).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, scored, n) of queries (query_id, text, variants): terms of variants only widen the filter."""
    own = queries.select("query_id", F.explode(F.array_distinct(T.terms("text"))).alias("term"), F.lit(True).alias("scored"))
    if "variants" in queries.columns:
        more = queries.where(F.size(T.terms("text")) > 0).select("query_id", F.explode(F.array_distinct(T.terms(F.array_join("variants", " ")))).alias("term"), F.lit(False).alias("scored"))
        own = own.union(more)
    own = own.groupBy("query_id", "term").agg(F.max("scored").alias("scored"))
    return own.withColumn("n", F.count_if("scored").over(W.partitionBy("query_id")))


#: Queries of a part of those that ask the same.
ALIKE = 1000


def alike(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, of, part, parts): the smallest id of the queries that have the same terms in an index (term, ...), and as many of their own. Those
    have the same ranking and scores, and are dealt to parts of ALIKE queries; queries without a term in the index aren't there."""
    known = query_terms(queries).join(terms.select("term"), "term")
    own = known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "scored"))).alias("own"), F.max("n").alias("n"))
    same = own.groupBy("own", "n").agg(F.min("query_id").alias("of"), F.ceil(F.count("*") / ALIKE).alias("parts"))
    return own.join(same, ["own", "n"]).select("query_id", "of", F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part"), "parts")


def keyword_hits(index: DataFrame, queries: DataFrame, slices: int = 0) -> DataFrame:
    """(query_id, key, score) of everything that holds a filter term: the sum of tf / (tf + SATURATION) over the scored
    terms, divided by their number. slices: those of a stored index, whose rows have the column slice; its side isn't shuffled."""
    part = F.when(F.col("scored"), F.col("tf") / (F.col("tf") + SATURATION)).otherwise(0.0)
    asked = query_terms(queries)
    if slices:
        met = index.join(asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), ["term", "slice"])
    else:
        met = index.join(bounded(asked), "term")
    return met.groupBy("query_id", "key").agg((F.sum(part) / F.max("n")).alias("score"))


def keyword_topk(index: DataFrame, queries: DataFrame, k: int, slices: int = 0) -> DataFrame:
    hits = keyword_hits(index, queries, slices)
    return top(hits, k, F.col("score")).select("query_id", "key", "rank", "score")


#: Documents of the most terms that tell what a query's k best score at least; impacts of a document that are kept; what sums may differ by.
SEEDS, IMPACTS, SLACK = 1000, 32, 1e-6


def impact(tf: Column) -> Column:
    """What a term's count adds to a keyword score, before it is divided by the number of terms."""
    return tf / (tf + SATURATION)


def document_bounds(rows: DataFrame, *scope: str) -> DataFrame:
    """(key, *scope, n, sums) of postings (key, tf, *scope): the number of a document's terms, and what its 1, 2, ... IMPACTS greatest
    impacts add up to."""
    best = rows.select("key", *scope, impact(F.col("tf")).alias("x")).groupBy("key", *scope, "x").agg(F.count("*").alias("c"))
    one = F.sort_array(F.collect_list(F.struct("x", "c")), asc=False)
    flat = F.slice(F.flatten(F.transform(one, lambda e: F.array_repeat(e["x"], F.least(e["c"], F.lit(IMPACTS)).cast("int")))), 1, IMPACTS)
    docs = best.groupBy("key", *scope).agg(F.sum("c").alias("n"), flat.alias("best"))
    add = lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) + x))
    return docs.select("key", *scope, "n", F.aggregate("best", F.array().cast("array<double>"), add).alias("sums"))


def pruned_hits(index: DataFrame, queries: DataFrame, k: int, slices: int, terms: DataFrame, docs: DataFrame) -> DataFrame:
    """keyword_hits() of the k best and some more, exactly. terms: (term, df, most), the greatest count; docs: those of document_bounds(), in
    scope. The best of SEEDS documents say what the k best score at least. A query's most frequent terms that can't
    reach that together are no reason to look at a document; what the others name is kept while the document's own greatest impacts could
    reach it, and only then the frequent terms are looked up. Without k seeds that score, all terms count."""
    asked = query_terms(queries).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    seeds = F.broadcast(docs.orderBy(F.desc("n"), "key").limit(SEEDS).select("key"))
    seen = index.join(seeds, "key").join(asked.where("scored"), ["term", "slice"]).groupBy("query_id", "key").agg(F.sum(impact(F.col("tf"))).alias("s"))
    worst = seen.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("s")))).where(F.col("_n") <= k)
    least = worst.groupBy("query_id").agg(F.count("*").alias("c"), (F.min("s") - SLACK).alias("least")).where(F.col("c") == k).select("query_id", "least")
    known = query_terms(queries).join(terms, "term").join(least, "query_id", "left")
    most = F.when(F.col("scored"), impact(F.col("most"))).otherwise(0.0)
    reach = F.sum("most").over(W.partitionBy("query_id").orderBy("scored", F.desc("df"), "term").rowsBetween(W.unboundedPreceding, 0))
    marked = known.withColumn("most", most).withColumn("names", F.coalesce(reach >= F.col("least"), F.lit(True)))
    later = F.col("scored") & ~F.col("names")
    whole = marked.groupBy("query_id").agg(F.first("least").alias("least"), F.first("n").alias("n"), F.sum(F.when(later, F.col("most")).otherwise(0.0)).alias("more"), F.collect_list(F.when(later, F.col("term"))).alias("rest"))
    naming = marked.where("names").select("query_id", "term", "scored").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    part = F.when(F.col("scored"), impact(F.col("tf"))).otherwise(0.0)
    named = index.join(naming, ["term", "slice"]).groupBy("query_id", "key").agg(F.sum(part).alias("s"))
    n = F.size("rest")
    own = F.coalesce(F.try_element_at("sums", F.least(n, F.size("sums"))), F.lit(0.0)) + F.greatest(n - IMPACTS, F.lit(0)) * F.when(F.col("n_terms") > IMPACTS, F.try_element_at("sums", F.lit(IMPACTS)) / IMPACTS).otherwise(0.0)
    own = F.when(n > 0, own).otherwise(0.0)
    near = named.join(whole, "query_id").where("least is null or s + more >= least").join(docs.select("key", F.col("n").alias("n_terms"), "sums"), "key")
    near = near.where(F.col("least").isNull() | (F.col("s") + F.least("more", own) >= F.col("least")))
    each = near.select("query_id", "key", "s", "n", F.explode_outer("rest").alias("term")).withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int"))
    met = each.join(index.select("term", "slice", "key", "tf"), ["term", "slice", "key"], "left")
    return met.groupBy("query_id", "key").agg(((F.max("s") + F.coalesce(F.sum(impact(F.col("tf"))), F.lit(0.0))) / F.max("n")).alias("score"))


#: Terms that name the documents which may hold a text.
NAMING = 3


def holding(rows: DataFrame, slices: int, docs: DataFrame, queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, key) of docs (key, text) that hold the whole text of a query (query_id, text), by a stored keyword index of them (rows,
    slices, terms). A text's inner terms stand whole in what holds it; documents that have the rarest of them are compared. Texts of
    fewer than three terms are compared with every document, in blocks."""
    words = T.terms("text")
    asked = queries.where("text <> ''").select("query_id", "text", F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))).alias("inner"))
    each = asked.select("query_id", F.size("inner").alias("all"), F.explode("inner").alias("term")).join(terms, "term")
    each = each.withColumn("found", F.count("*").over(W.partitionBy("query_id"))).where(F.col("found") == F.col("all"))
    each = each.withColumn("at", F.row_number().over(W.partitionBy("query_id").orderBy("df", "term"))).where(F.col("at") <= NAMING)
    each = each.select("query_id", "term", F.least("all", F.lit(NAMING)).alias("n")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    near = rows.join(each, ["term", "slice"]).groupBy("query_id", "key").agg(F.count("*").alias("met"), F.first("n").alias("n")).where("met >= n").select("query_id", "key")
    near = near.join(asked.select("query_id", F.col("text").alias("_text")), "query_id").join(docs, "key")
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(32)).cast("int")
    short = asked.where(F.size("inner") == 0).select("query_id", F.col("text").alias("_text"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("_block"))
    rest = docs.withColumn("_block", block("key")).join(short, "_block")
    columns = ["query_id", "key", "_text", "text"]
    return near.select(*columns).union(rest.select(*columns)).where(F.contains("text", "_text")).select("query_id", "key")


def nearest(units: DataFrame, asked: DataFrame, by: list[str], k: int) -> DataFrame:
    """(query_id, key, score) of unit vectors (*by, key, u) for asked ones (*by, query_id, q) that meet on the columns `by`: the k best
    of each query within each meeting, of positive scores. A block is one product of matrices; what it leaves is scored anew, summed in the order of
    V.dot."""
    whole = lambda rows, c: rows.where(~F.exists(c, lambda x: x.isNull())).withColumn("_dim", F.size(c))
    matrix = lambda column: column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    scores = BLOCK_SCORES
    kinds = asked.schema["query_id"].dataType.simpleString(), units.schema["key"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            u, q = matrix(left["u"]), matrix(right["q"])
            place = pc.rank(left["key"], sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
            step = max(1, scores // len(u))
            for start in range(0, len(q), step):
                near = q[start : start + step] @ u.T
                near[np.isnan(near)] = np.inf  # Spark orders NaN above all numbers
                low = np.partition(near, len(u) - k, axis=1)[:, [len(u) - k]] if len(u) > k else -np.inf
                i, j = np.nonzero(near >= np.maximum(low - 4e-9, 1e-10))
                score = np.concatenate([np.zeros(0), *[np.cumsum(q[start + i[a : a + 65536]] * u[j[a : a + 65536]], axis=1)[:, -1] for a in range(0, len(i), 65536)]])
                ranked = np.where(np.isnan(score), np.inf, np.round(score, 9))
                order = np.lexsort((place[j], -ranked, i))
                i, j, score, ranked = i[order], j[order], score[order], ranked[order]
                first = np.searchsorted(i, i)
                best = (np.arange(len(i)) - first < k) & (ranked > 0)
                rows.append((start + i[best], j[best], score[best]))
        i, j, score = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": right["query_id"].take(pa.array(i)), "key": left["key"].take(pa.array(j)), "score": score})

    by = [*by, "_dim"]
    met = whole(units, "u").groupBy(*by).cogroup(whole(asked, "q").groupBy(*by))
    return met.applyInArrow(run, f"query_id {kinds[0]}, key {kinds[1]}, score double")


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, key, rank, score): cosine of every query vector with every vector (key, embedding), where it is positive. Both are dealt
    to blocks of bounded size, and every block of queries meets every block of vectors. Exact; vector_index has the approximate way."""
    units = vectors.where("embedding is not null").select("key", V.unit(F.col("embedding")).alias("u"))
    asked = queries.where("embedding is not null").select("query_id", V.unit(F.col("embedding")).alias("q"))
    blocks, parts = (max(1, -(-rows.count() // block_rows)) for rows in (vectors, queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    units = units.withColumn("_block", dealt("key", blocks)).withColumn("_part", every(parts))
    asked = asked.withColumn("_part", dealt("query_id", parts)).withColumn("_block", every(blocks))
    return top(nearest(units, asked, ["_block", "_part"], k), k, F.col("score")).select("query_id", "key", "rank", "score")


def best_of_variants(ranked: DataFrame, of: str) -> DataFrame:
    """(query_id, key, rank) of rankings of variants: the best rank of a key, ranked anew."""
    best = ranked.groupBy(F.col(of).alias("query_id"), "key").agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("best", "key"))).select("query_id", "key", "rank")


def title_topk(index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, rank, score) of the pages of a stored index of titles (indexes.TitleIndex) for queries (query_id, text[, variants]). A
    page is a candidate if its title or url holds a term of the query or its variants, or one of them without spaces;
    only the query's own terms score."""
    variants = F.coalesce(F.col("variants"), F.array().cast("array<string>")) if "variants" in queries.columns else F.array().cast("array<string>")
    wanted, squeezed = F.array_distinct(T.terms("text")), T.collapse("text")
    own = queries.select("query_id", wanted.alias("wanted"), squeezed.alias("squeezed"), F.array_distinct(F.concat(wanted, T.terms(F.array_join(variants, " ")))).alias("near"), F.array_union(F.array(squeezed), F.transform(variants, T.collapse)).alias("close"))
    asked = own.where(F.size("wanted") > 0)
    each = asked.select("query_id", F.explode(F.concat(F.transform("near", lambda x: F.struct(x.alias("needle"), F.lit(False).alias("close"))), F.transform("close", lambda x: F.struct(x.alias("needle"), F.lit(True).alias("close"))))).alias("x"))
    each = each.select("query_id", "x.needle", "x.close").where("needle <> ''").distinct()
    found = index.holding(each.select("needle", "close").distinct()).join(each, ["needle", "close"]).select("query_id", "key").distinct()
    met = found.join(index.pages, "key").join(asked.select("query_id", "wanted", "squeezed"), "query_id")
    shared = F.size(F.array_intersect("wanted", "terms"))
    whole = ((F.col("squeezed") != "") & F.contains("closed", "squeezed")).cast("int")
    scored = met.withColumn("score", F.greatest(shared, whole) / F.size("wanted"))
    ordered = W.partitionBy("query_id").orderBy(F.col("score") <= 0, F.round("score", 9).desc(), "key")
    return scored.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).select("query_id", "key", "rank", "score")


def fold(ranked: DataFrame, owner: DataFrame) -> DataFrame:
    """Chunk rankings as document rankings: (query_id, key, rank, winner). owner: (chunk, key); a document has the rank
    of its best chunk, which is the winner, and is ranked anew."""
    best = ranked.withColumnRenamed("key", "chunk").join(owner, "chunk").groupBy("query_id", "key").agg(F.min("rank").alias("best"), F.min_by("chunk", "rank").alias("winner"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("best", "key"))).select("query_id", "key", "rank", "winner")


ARMS = ("keyword", "vector", "title")


def places(arms: dict[str, DataFrame]) -> DataFrame:
    """(query_id, key, keyword, vector, title): a key's place in each arm (query_id, key, rank). The first place of a key in an arm
    counts, and places are numbered anew."""
    rows = None
    for name in ARMS:
        if name in arms:
            own = arms[name].select("query_id", "key", "rank", F.lit(name).alias("arm"))
            rows = own if rows is None else rows.union(own)
    first = rows.groupBy("query_id", "arm", "key").agg(F.min("rank").alias("first"))
    again = first.withColumn("place", F.row_number().over(W.partitionBy("query_id", "arm").orderBy("first", "key")))
    return again.groupBy("query_id", "key").agg(*[F.max(F.when(F.col("arm") == a, F.col("place"))).alias(a) for a in ARMS])


def by_shares(placed: DataFrame, top_k: int, k: Column, *by: str) -> DataFrame:
    """Places with rank, score and match_type, the top_k of each query and value of `by`. The arms' shares are added in
    the order of ARMS; a key that only the title arm has is labelled vector."""
    share = lambda a: F.coalesce(F.lit(1.0) / (k + F.col(a)), F.lit(0.0))
    scored = placed.withColumn("score", share("keyword") + share("vector") + share("title"))
    label = F.when(F.col("keyword").isNotNull() & F.col("vector").isNotNull(), "both").when(F.col("keyword").isNotNull(), "keyword").otherwise("vector")
    ordered = W.partitionBy(*by, "query_id").orderBy(F.col("score").desc(), F.col("key"))
    ranked = scored.withColumn("match_type", label).withColumn("rank", F.row_number().over(ordered))
    return ranked.where(F.col("rank") <= top_k).select(*by, "query_id", "key", "rank", "score", "match_type")


def fuse(arms: dict[str, DataFrame], top_k: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of arms: (query_id, key, rank, score, match_type)."""
    return by_shares(places(arms), top_k, F.lit(k))


def winners(arms: dict[str, DataFrame]) -> DataFrame:
    """(query_id, key, winner): the chunk that brought a document in, from folded arms; the keyword arm's before the vector arm's."""
    rows = None
    for n, name in enumerate(ARMS):
        if name in arms and "winner" in arms[name].columns:
            own = arms[name].select("query_id", "key", F.lit(n).alias("arm"), "winner")
            rows = own if rows is None else rows.union(own)
    return rows.groupBy("query_id", "key").agg(F.min_by("winner", "arm").alias("winner"))


def fallback(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """The keyword arm, and the vector arm of the queries for which it has nothing."""
    rest = vector.join(keyword.select("query_id").distinct(), "query_id", "left_anti")
    return keyword.withColumn("match_type", F.lit("keyword")).unionByName(rest.withColumn("match_type", F.lit("vector")))


def exact_matches(endpoints: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, key, rank) where a query is `METHOD /path`, or else an operation id, of endpoints (key, method, path,
    operation_id)."""
    shape = r"(?i)^\s*(GET|PUT|POST|DELETE|OPTIONS|HEAD|PATCH|TRACE)\s+(/\S+)\s*$"
    asked = queries.select("query_id", F.upper(F.regexp_extract("text", shape, 1)).alias("method"), F.regexp_extract("text", shape, 2).alias("path"), F.trim("text").alias("operation_id"))
    by_path = endpoints.join(asked.where("method <> ''").drop("operation_id"), ["method", "path"]).select("query_id", "key")
    by_name = endpoints.join(asked.where("method = ''").drop("method", "path"), "operation_id").select("query_id", "key")
    return by_path.union(by_name).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("key")))


def exact_then_rest(exact: DataFrame, rest: DataFrame, top_k: int) -> DataFrame:
    """(query_id, key, rank, match_type): exact matches, then the slots they leave from the fused ranking. What the exact
    matches hold already is dropped after the cut, so a result can be shorter than top_k."""
    taken = exact.where(F.col("rank") <= top_k).withColumn("match_type", F.lit("exact")).withColumn("stage", F.lit(0))
    used = taken.groupBy("query_id").agg(F.count("*").alias("used"))
    left = rest.join(used, "query_id", "left").where(F.col("rank") <= top_k - F.coalesce("used", F.lit(0)))
    left = left.join(taken.select("query_id", "key"), ["query_id", "key"], "left_anti").withColumn("stage", F.lit(1))
    both = taken.select("query_id", "key", "rank", "match_type", "stage").union(left.select("query_id", "key", "rank", "match_type", "stage"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("stage", "rank"))).drop("stage")


def weighted(candidates: DataFrame, queries: DataFrame, top_k: int, budget: int) -> DataFrame:
    """(query_id, key, rank, score) of title candidates (query_id, key, rank, score, title, body): the `budget` best get
    their bodies scored, 0.4 title + 0.6 body, rounded to four digits; ties by title, then key."""
    asked = queries.select("query_id", F.col("text").alias("query"), T.terms("text").alias("wanted"))
    read = candidates.where(F.col("rank") <= budget).withColumnRenamed("score", "title_score").join(bounded(asked), "query_id")
    body = F.when(F.coalesce("body", F.lit("")) == "", 0.0).otherwise(T.body_score(F.col("query"), F.col("wanted"), F.col("body")))
    scored = read.withColumn("score", F.round(F.round(0.4 * F.col("title_score") + 0.6 * body, 9), 4))
    ordered = W.partitionBy("query_id").orderBy(F.col("score").desc(), "title", "key")
    return scored.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top_k).select("query_id", "key", "rank", "score")
