"""Benchmark decontamination by a distributed positional inverted index.

`build_index` stores postings (term, doc_id, pos) of the documents' words, for the terms of the benchmark or for
all, and one posting of an end mark whose position is the document's length. A lookup takes each window's rarest
terms from the stored counts, shifts their postings by the term's place in the item, and intersects the shifted
lists: what meets on (item, document, shift) is a candidate alignment. The candidates are then compared with
the documents' words, which decides phrase matches exactly. `proximity` intersects lists with a slack instead.

Everything is DataFrame operations. Lists of frequent terms are not met unless every term of a window is
frequent; the shifted postings are summed up per (item, document, shift) before they are shuffled, and an
alignment is a row, so no term, item or document gathers in one task.

Results in odd cases: a null or empty text has no words: zeros and an empty list; items without words match
nothing; a null item_id is skipped; an item_id with several texts is found where any of them is, and listed once. In report() and
clean() every row is a document by itself, whatever its doc_id: rows are told apart by doc_id and text, and equal rows have equal
results. The functions below them take doc_id as the key of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, joined_if_small, stored

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No word holds a space.
END = " end"
#: Rarest terms of a window whose lists are intersected before the words are compared.
ANCHORS = 3
#: Rows of benchmark terms, items or candidate documents that are broadcast at most; beyond, they are shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Stored postings (term, doc_id, pos) of docs (doc_id, text), of the given terms (term) only if there are any."""
    marked = docs.select("doc_id", F.concat(words(F.col("text")), F.array(F.lit(END))).alias("words"))
    postings = marked.select("doc_id", F.posexplode("words").alias("pos", "term"))
    if terms is not None:
        wanted = stored(terms.select("term").union(docs.sparkSession.range(1).select(F.lit(END).alias("term"))).distinct(), "terms")
        postings = joined_if_small(postings, wanted, "term", "left_semi", wanted.count(), BROADCAST_ROWS)
    return stored(postings.select("term", "doc_id", "pos"), "postings")


def windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, item_words, size) of items (item_id, text); an item of fewer words is one window."""
    return (
        items.where("item_id is not null")
        .groupBy("item_id")
        .agg(F.min("text").alias("text"))
        .select("item_id", words(F.col("text")).alias("item_words"))
        .where(F.size("item_words") > 0)
        .withColumn("size", F.least(F.lit(window), F.size("item_words")))
    )


def anchors(items: DataFrame, index: DataFrame) -> DataFrame:
    """(item_id, place, term, rank): the rarest terms of every window of the items, rarest first."""
    terms = items.select("item_id", "size", F.size("item_words").alias("length"), F.posexplode("item_words").alias("place", "term"))
    counted = terms.join(index.groupBy("term").agg(F.count("*").alias("n")), "term")
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("size") + 1), F.least("place", F.col("length") - F.col("size"))))
    ranked = counted.withColumn("start", starts).withColumn("rank", F.row_number().over(W.partitionBy("item_id", "start").orderBy("n", "place")))
    # a window with a term that is nowhere can't match
    whole = ranked.withColumn("found", F.count("*").over(W.partitionBy("item_id", "start"))).where("found = size")
    return whole.where(F.col("rank") <= ANCHORS).select("item_id", "start", "place", "term", "size")


def candidates(anchored: DataFrame, index: DataFrame, rows: int) -> DataFrame:
    """(doc_id, item_id, shift): where the item's first word would stand for the anchors of a window to fit."""
    lists = anchored.select("item_id", "place", "term").distinct()
    shifted = joined_if_small(index, lists, "term", "inner", rows, BROADCAST_ROWS)
    # places by their remainder: two that share a bit only let through a candidate that the words then refute
    bit = F.expr("shiftleft(1L, place % 64)")
    met = shifted.groupBy("doc_id", "item_id", (F.col("pos") - F.col("place")).alias("shift")).agg(F.bit_or(bit).alias("places"))
    needs = anchored.groupBy("item_id", "start").agg(F.bit_or(bit).alias("need")).groupBy("item_id").agg(F.collect_set("need").alias("needs"))
    fits = joined_if_small(met, needs, "item_id", "inner", rows, BROADCAST_ROWS)
    return fits.where(F.exists("needs", lambda need: need.bitwiseAND(F.col("places")) == need)).select("doc_id", "item_id", "shift")


def phrase_matches(docs: DataFrame, items: DataFrame, index: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, item_id, pos, size) of every place of docs where a window of an item occurs."""
    cut = stored(windows(items, window), "items")
    anchored = stored(anchors(cut, index), "anchors")
    found = stored(candidates(anchored, index, anchored.count()), "candidates")
    held = stored(found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift")).alias("found")), "candidates")
    lengths = cut.select("item_id", F.size("item_words").alias("length"))
    n_items = cut.count()
    # of each candidate only the words beside the item leave the document's row
    texts = joined_if_small(docs.select("doc_id", "text"), held, "doc_id", "inner", held.count(), BROADCAST_ROWS // 4)
    longest = cut.agg(F.coalesce(F.max(F.size("item_words")), F.lit(0))).first()[0]
    beside = texts.select("doc_id", words(F.col("text")).alias("words"), "found").select(
        "doc_id", F.explode(F.transform("found", lambda a: F.struct(a.item_id.alias("item_id"), a["shift"].alias("shift"), F.slice("words", F.greatest(a["shift"], F.lit(0)) + 1, longest).alias("own")))).alias("a")
    )
    both = joined_if_small(beside.select("doc_id", "a.*"), cut.join(lengths, "item_id"), "item_id", "inner", n_items, BROADCAST_ROWS // 10)
    # place in `own` of the item's place q: q + the shift, if that is negative
    lead = F.least("shift", F.lit(0))
    places = F.sequence(-lead, F.greatest(F.col("length") - F.col("size"), -lead))
    fits = F.filter(places, lambda q: (q <= F.col("length") - F.col("size")) & (F.slice("own", q + lead + 1, F.col("size")) == F.slice("item_words", q + 1, F.col("size"))))
    return both.select("doc_id", "item_id", "size", F.explode(fits).alias("q"), "shift").select("doc_id", "item_id", (F.col("q") + F.col("shift")).alias("pos"), "size")


def proximity(index: DataFrame, terms: list[str], slack: int) -> DataFrame:
    """(doc_id, pos, span) where all terms stand within `slack` words, from the rarest term's places outwards."""
    counts = {r["term"]: r["n"] for r in index.where(F.col("term").isin(terms)).groupBy("term").agg(F.count("*").alias("n")).collect()}
    if any(t not in counts for t in terms):
        return index.select("doc_id", F.col("pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("span")).where("false")
    first, *others = sorted(set(terms), key=lambda t: (counts[t], t))
    near = index.where(F.col("term") == first).select("doc_id", "pos", F.col("pos").alias("low"), F.col("pos").alias("high"))
    for term in others:
        own = index.where(F.col("term") == term).select("doc_id", F.col("pos").alias("at"))
        widened = near.join(own, "doc_id").select("doc_id", "pos", F.least("low", "at").alias("low"), F.greatest("high", "at").alias("high"))
        near = widened.where(F.col("high") - F.col("low") <= slack).distinct()
    return near.groupBy("doc_id", F.col("pos").cast("long").alias("pos")).agg(F.min(F.col("high") - F.col("low")).cast("long").alias("span"))


def _key(id_: str) -> Column:
    """Tells rows apart that share an id."""
    return F.struct(F.col(id_).alias("id"), F.xxhash64("text").alias("text"))


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items) for every document; items: sorted ids of those of which a window
    occurs in it."""
    docs = docs.select(_key("doc_id").alias("doc_id"), "text")
    items = items.where("item_id is not null").select(_key("item_id").alias("item_id"), "text")
    terms = windows(items, window).select(F.explode("item_words").alias("term"))
    index = build_index(docs, terms)
    hits = stored(phrase_matches(docs, items, index, window), "hits")
    spans = hits.groupBy("doc_id", "pos").agg(F.max("size").alias("size"))
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("pos") + F.col("size")
    fresh = F.greatest(F.lit(0), end - F.greatest("pos", F.coalesce(F.max(end).over(before), F.col("pos"))))
    covered = spans.select("doc_id", fresh.alias("fresh")).groupBy("doc_id").agg(F.sum("fresh").alias("n_hit"))
    found = hits.select("doc_id", F.col("item_id.id").cast("string").alias("item")).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    hit = stored(covered.join(found, "doc_id"), "hit")
    lengths = index.where(F.col("term") == END).select("doc_id", F.col("pos").cast("long").alias("n_words"))
    all_ = joined_if_small(lengths, hit, "doc_id", "left", hit.count(), BROADCAST_ROWS // 10)
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return all_.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.text").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Docs without those in which a window of an item occurs."""
    dropped = stored(report(docs, items, window).where("n_hit > 0").select(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("text")).alias("_row_key")).distinct(), "dropped")
    return joined_if_small(docs.withColumn("_row_key", _key("doc_id")), dropped, "_row_key", "left_anti", dropped.count(), BROADCAST_ROWS).select(*docs.columns)
