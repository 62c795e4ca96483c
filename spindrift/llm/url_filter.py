"""URL filters: rules for hosts and path prefixes, and gradient-boosted trees for the urls that no rule fits.

The urls that a rule fits are the labelled ones. Trees are boosted on lexical features of a bounded sample of
them (the TRAIN_ROWS with the smallest hash of the url): lengths, depth, digit ratio, entropy of the characters,
parameter counts, and statistics of the host's suffix and of the first path part over all urls. Everything runs
as DataFrame operations and in the JVM.

Results in odd cases: a url that is null or has no `://` has an empty host and path, fits no rule and gets the
model's verdict; of equally long rules that fit, the alphabetically first wins; without labelled urls of both
kinds the verdict is that of the labelled ones, or allow; rows that repeat are judged one by one.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, joined_if_small, stored

#: Labelled urls the trees are fitted on at most; trees and their depth.
TRAIN_ROWS, TREES, DEPTH = 20_000, 20, 4
#: Parts of the hosts; the statistics of one part's labelled urls come from the others.
FOLDS = 5
#: Suffixes, or path parts, by fold, whose statistics are broadcast at most.
BROADCAST_ROWS = 100_000
FEATURES = ["url_length", "host_length", "path_length", "host_depth", "path_depth", "digits", "entropy", "parameters", "hyphens", "fragment", "suffix_share", "suffix_blocked", "part_share", "part_blocked"]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest of the rules `host/path` that fits, else null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        own, _, prefix = rule.partition("/")
        out = F.when(((host == own) | host.endswith("." + own)) & path.startswith("/" + prefix), F.lit(rule)).otherwise(out)
    return out


def ruled(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(page_id, url, host, path, rule, given): given is the rule's verdict."""
    split = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = split.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), list(rules)))
    given = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        given = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(given)
    return rows.withColumn("given", given)


def _entropy(text: Column) -> Column:
    """Bits a character, from the characters' shares."""
    chars = F.split(text, "")
    n = F.length(text)
    share = F.transform(F.array_distinct(chars), lambda c: F.when(c == "", F.lit(0.0)).otherwise((n - F.length(F.replace(text, c, F.lit("")))) / n))
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda t, p: t - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical(rows: DataFrame) -> DataFrame:
    """Rows of ruled() with lexical features, and the keys of statistics."""
    url = F.coalesce("url", F.lit(""))
    count = lambda text, what: F.regexp_count(text, F.lit(what)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        count(F.col("host"), r"\.").alias("host_depth"),
        count(F.col("path"), r"/[^/]").alias("path_depth"),
        (count(url, r"[0-9]") / F.greatest(F.length(url), F.lit(1))).alias("digits"),
        _entropy(url).alias("entropy"),
        count(query, r"[^&]+").alias("parameters"),
        count(url, r"[-_]").alias("hyphens"),
        F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        F.substring_index("host", ".", -1).alias("suffix"),
        F.regexp_extract("path", r"^/+([^/]*)", 1).alias("part"),
    )


def with_statistics(rows: DataFrame) -> DataFrame:
    """Share of all urls, and share of blocked among the labelled, for a url's suffix and first path part. Hosts are dealt to FOLDS; a
    labelled url's share of blocked is that of the other folds, so that no label, its own or its host's, is a feature of itself."""
    total = rows.count()
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    for key in ("suffix", "part"):
        own = rows.groupBy(key, "fold").agg(F.count("*").alias("n"), F.count("given").alias("labelled"), F.count_if(F.col("given") == "block").alias("block"))
        every = lambda c: F.sum(c).over(W.partitionBy(key))  # noqa: E731  FOLDS rows a key at most
        smoothed = lambda block, labelled: (block + 1) / (labelled + 2)
        known = own.select(
            key, "fold", (every("n") / F.lit(max(1, total))).alias(f"{key}_share"), smoothed(every("block"), every("labelled")).alias("_all"),
            smoothed(every("block") - F.col("block"), every("labelled") - F.col("labelled")).alias("_others"),
        )
        known = stored(known, "shares")
        rows = joined_if_small(rows, known, [key, "fold"], "left", known.count(), BROADCAST_ROWS)
        rows = rows.withColumn(f"{key}_blocked", F.when(F.col("given").isNotNull(), F.col("_others")).otherwise(F.col("_all"))).drop("_all", "_others")
    return rows.drop("fold")


def fit(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> GBTClassificationModel | str:
    """Boosted trees of rows with FEATURES and given; or the verdict of all labelled rows, if they agree."""
    kinds = [r["given"] for r in rows.where("given is not null").select("given").distinct().limit(2).collect()]
    if len(kinds) < 2:
        return kinds[0] if kinds else "allow"
    labelled = rows.where("given is not null").select(*FEATURES, (F.col("given") == "block").cast("double").alias("label"), F.xxhash64("url").alias("h"))
    sample = stored(labelled.orderBy("h", *FEATURES).limit(train_rows).drop("h").coalesce(1), "urls")
    if sample.select("label").distinct().count() < 2:
        return "block" if sample.first()["label"] else "allow"
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    return GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, cacheNodeIds=False).fit(data)


def judge(pages: DataFrame, rules: dict[str, str], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked) of pages (page_id, url); rules: `host/path` to block or allow.
    blocked: the model's probability."""
    rows = stored(lexical(ruled(pages, rules)), "urls")
    rows = with_statistics(rows)
    model = fit(rows, train_rows)
    if isinstance(model, str):
        scored = rows.withColumn("blocked", F.lit(1.0 if model == "block" else 0.0))
    else:
        data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        scored = model.transform(data).withColumn("blocked", vector_to_array("probability")[1])
    guess = F.when(F.col("blocked") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", guess).alias("verdict"), "blocked")
