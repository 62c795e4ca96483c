"""Connected groups of things that share buckets, without emitting all pairs of a bucket.

`components` is the large-star / small-star method. `link` takes (key, v) rows and what decides pairs. First every
bucket's members are compared with one pivot, the member that shares most with others, so a group of near copies
gathers around the text they come from. Then only buckets whose members are in different groups are open. In those
that aren't large, members of different groups are held against each other within the join, on bounds that
cost nothing to read, and only what these leave over is emitted and verified. Members of a larger open bucket go on in
narrower ones: any two that are linked with each other, though not both with the pivot, have a key in common that
`narrow` names. The pivots so far are part of the key and none of its members, so every bucket is part of an earlier
one, and smaller. Buckets with the same members are met once. No link between different groups is lost.

Where no such keys are known, there is no `narrow`, and a bucket of any size is held against itself whole: cut into blocks of
BLOCK members, each of which meets all others in a task of its own. That is exact; its work grows with the square of the
members in different groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, stored

#: Members of a bucket that are held against each other at most; a larger one is narrowed first.
LARGE = 1000
#: Members of a bucket that meet all others of it in one task, where buckets aren't narrowed.
BLOCK = 2000


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for the ends of the edges (a, b); label is the smallest v of the group."""
    least, greatest = F.least("a", "b"), F.greatest("a", "b")
    first = pairs = stored(edges.where("a <> b").select(greatest.alias("a"), least.alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, pairs = pairs, stored(small.select("e.*").where("a <> b").distinct(), "edges")
        if before is not first:
            freed(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    vertices = first.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    labels = vertices.join(pairs.select(F.col("a").alias("v"), F.col("b").alias("label")), "v", "left")
    out = stored(labels.select("v", F.coalesce("label", "v").alias("label")), "labels")
    freed(first, pairs)
    return out


def _open(rows: DataFrame) -> DataFrame:
    """rows (key, v, label, chain, asks) of the buckets that hold several labels and a member that asks, with their size n; of
    buckets with the same members, of whom the same ask, one."""
    groups = rows.groupBy("key", "label").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("v", "asks")).alias("who"), F.max("asks").alias("asks"))
    sizes = groups.groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("labels"), F.bit_xor("who").alias("who"), F.max("asks").alias("asks"))
    sizes = sizes.where("labels > 1 and asks")
    return rows.join(sizes.groupBy("n", "who").agg(F.min("key").alias("key")).drop("who"), "key")


def link(members: DataFrame, bounds: DataFrame, near: Callable[[], Column], check: Callable[[DataFrame], DataFrame], narrow: Callable[[DataFrame], DataFrame] | None, large_from: int = LARGE, *, pivot_from: int = 1) -> DataFrame:
    """(v, label) of everything in a group of two or more.

    members: distinct (key, v), or (key, v, asks): of two members that meet, one must ask. bounds: for each v, the columns that near() reads with the suffixes _a and _b, beside
    `members`, the size of the smallest bucket they met in: whether a pair may be linked. check: of distinct pairs (a, b) for which near() holds, those that are linked, as stored(). narrow: of
    distinct (v, p), p being a pivot, (v, p, keys); None if there are no keys that surely tell those that are linked. Buckets of up to pivot_from members have no pivot."""
    own = [bounds.select(*[F.col(c).alias(f"{c}_{s}") for c in bounds.columns]) for s in "ab"]

    def found(pairs: DataFrame, label: str) -> DataFrame:
        pairs = stored(pairs, label)
        out = check(pairs)
        freed(pairs)
        return out

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.drop("label").join(labels, "v", "left").select("key", "v", F.coalesce("label", "v").alias("label"), "chain", "asks")

    asks = F.col("asks") if "asks" in members.columns else F.lit(True)
    shared = stored(_open(members.select("key", "v", F.col("v").alias("label"), F.lit(0).cast("long").alias("chain"), asks.alias("asks"))), "buckets")
    links, labels = None, None
    while not shared.isEmpty():
        pivoted = shared.where(F.col("n") > pivot_from)
        weight = shared.groupBy("v").agg(F.sum("n").alias("w"))
        pivot = pivoted.join(weight, "v").groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "v")).alias("p"))
        met = stored(pivoted.join(pivot, "key").where("v <> p.v").select("key", "v", "n", F.col("p.v").alias("p")), "met")
        pairs = met.groupBy(F.least("v", "p").alias("a"), F.greatest("v", "p").alias("b")).agg(F.min("n").alias("members"))
        pairs = pairs.join(own[0], F.col("a") == F.col("v_a")).join(own[1], F.col("b") == F.col("v_b")).where(near()).select("a", "b")
        now = found(pairs, "pairs")
        links = now if links is None else links.union(now)
        before, labels = labels, components(links)
        if before is not None:
            freed(before)
        # what is open in buckets that are not large
        rest = stored(_open(labelled(shared)), "open")
        small = rest if narrow is None else rest.where(F.col("n") <= large_from)
        side = [small.select("key", "asks", F.col("v").alias(s), F.col("label").alias(f"label_{s}"), F.col("n").alias("members")).join(own[i], F.col(s) == F.col(f"v_{s}")) for i, s in enumerate("ab")]
        blocks = F.ceil(F.col("members") / BLOCK)
        # those that ask are dealt to blocks, which the others meet in each of them
        asking = side[0].where("asks").withColumn("block", F.pmod(F.xxhash64("a"), blocks)).drop("asks")
        asked = side[1].withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("members")
        once = (F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & ~F.col("asks"))
        apart = asking.join(asked, (asking.key == asked.key) & (asking.block == asked.block) & once & (F.col("label_a") != F.col("label_b")) & near())
        apart = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = found(apart.select("a", "b").distinct(), "pairs")
        if not more.isEmpty():
            links = links.union(more)
            before, labels = labels, components(links)
            freed(before)
        else:
            freed(more)
        freed(shared)
        large = rest.where(F.col("n") > large_from).select("key", "v", "chain", "asks")
        if narrow is None or large.isEmpty():
            freed(rest, met)
            break
        every, met = met, stored(large.join(met, ["key", "v"]).select("v", "p", F.xxhash64("chain", "p").alias("chain"), "asks").distinct(), "met")
        freed(rest, every)
        keys = narrow(met.select("v", "p").distinct())
        rows = met.join(keys, ["v", "p"]).select("v", "chain", "asks", F.explode("keys").alias("e")).select(F.xxhash64("chain", "e").alias("key"), "v", "chain", "asks")
        shared = stored(_open(labelled(rows.withColumn("label", F.col("v")))), "buckets")
        freed(met)
    if labels is None:
        return members.select("v", F.col("v").alias("label")).where("false")
    freed(links)
    return labels
