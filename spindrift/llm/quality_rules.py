"""Quality rules as weak supervision.

Every rule looks at figures of a document and votes good, bad, or abstains. How far each rule can be trusted is
not set but estimated. A document is good or has one of several faults, one kind for each rule that can find it;
in each of these classes every rule that votes has its own chance of voting bad. The votes of all documents are
counted by pattern (at most 3 to the number of rules, which bounds what the driver gets), and expectation-
maximisation over the patterns finds the share of the classes and the chances; abstaining says nothing. A
document is kept if its posterior probability of being good is at least one half. The start and a weak prior
say that a rule rarely blames a good document and mostly finds its own fault; that is what names the classes.

Results in odd cases: a null or empty text has no words: all figures are 0, and rules that divide by a count
abstain; rows that repeat are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import space_words, stored

SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of the languages told apart here.
STOP_WORDS = "the of and to in is that a la le les de des et un une que en el los der die das und ist ein eine mit con por se".split()
#: Rounds of expectation-maximisation, and the weight of the prior against the documents.
ROUNDS, PRIOR_SHARE = 40, 0.02
#: The prior, and the start: share of good documents; the chance that a rule that votes blames a good document, one
#: with the rule's own fault, one with another fault.
PRIOR_GOOD, BLAMES_GOOD, FINDS_OWN, FINDS_OTHER = 0.9, 0.002, 0.9, 0.1
GOOD, BAD, ABSTAIN = 1, 2, 0
#: Words from which the number of different ones is expected to grow as a power of the words, and that power.
STEADY, GROWTH = 5000, 0.6


def figures(docs: DataFrame, window: int = 5) -> DataFrame:
    """Docs with figures of `text`. n_repeat_words: words in windows of so many words that occur twice in the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.withColumn("_words", space_words(text)).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_words")
    count = F.greatest(n - (window - 1), F.lit(0))
    hashed = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice("_words", i, window)))).otherwise(F.array().cast("array<bigint>"))
    cut = cut.withColumn("_runs", hashed).withColumn("_lower", F.transform("_words", lambda w: F.lower(w)))
    # windows sorted by hash, beside their neighbours
    place = cut.withColumn("_sorted", F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), F.array_sort(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    n_runs = F.size("_sorted")
    beside = F.arrays_zip(F.col("_sorted").alias("own"), F.concat(none, F.slice("_sorted", 1, n_runs - 1)).alias("low"), F.concat(F.slice("_sorted", 2, n_runs), none).alias("high"))
    twice = F.filter(beside, lambda z: z["own"]["h"].eqNullSafe(z["low"]["h"]) | z["own"]["h"].eqNullSafe(z["high"]["h"]))
    place = place.withColumn("_at", F.array_sort(F.transform(twice, lambda z: z["own"]["i"])))
    fresh = F.zip_with("_at", F.concat(F.array(F.lit(-window)), F.slice("_at", 1, F.size("_at") - 1)), lambda a, b: F.least(F.lit(window), a - b))
    repeated = F.coalesce(F.aggregate(fresh, F.lit(0), lambda t, x: t + x), F.lit(0))
    stops = F.array(*map(F.lit, STOP_WORDS))
    out = place.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_lower")).cast("long").alias("n_distinct"),
        F.size(F.array_intersect("_lower", stops)).cast("long").alias("n_stops"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("!!|!$")).cast("long").alias("n_shouts"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?:;\"')][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
    )
    return out


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_stops", "n_upper", "n_shouts", "n_ended"]


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def votes() -> dict[str, Column]:
    """The rules, over the columns of figures()."""
    c = {x: F.col(x) for x in FIGURES}
    some = c["n_words"] > 0
    # different words grow with the words at first, then with a power of them
    expected = c["n_words"] * F.least(F.lit(1.0), F.pow(STEADY / F.greatest(c["n_words"], F.lit(1)), F.lit(1 - GROWTH)))
    return {
        "words": _vote(c["n_words"] < 10, c["n_words"] >= 20),
        "symbols": _vote(some & (5 * c["n_symbols"] > c["n_words"]), some & (50 * c["n_symbols"] <= c["n_words"])),
        "lines": _vote((c["n_lines"] > 4) & (10 * c["n_dup_lines"] > 4 * c["n_lines"]), (c["n_lines"] > 2) & (c["n_dup_lines"] == 0)),
        "repeats": _vote(some & (5 * c["n_repeat_words"] > c["n_words"]), (c["n_words"] >= 20) & (50 * c["n_repeat_words"] <= c["n_words"])),
        "length": _vote(some & ((2 * c["word_chars"] < 5 * c["n_words"]) | (c["word_chars"] > 12 * c["n_words"])), some & (2 * c["word_chars"] >= 7 * c["n_words"]) & (c["word_chars"] <= 9 * c["n_words"])),
        "capitals": _vote(some & (2 * c["n_upper"] > c["word_chars"]), some & (6 * c["n_upper"] <= c["word_chars"])),
        "shouts": _vote(some & (10 * c["n_shouts"] > c["n_words"]), some & (50 * c["n_shouts"] <= c["n_words"])),
        "stops": _vote((c["n_words"] >= 60) & (c["n_stops"] == 0), (c["n_words"] >= 20) & (c["n_stops"] >= 3)),
        "variety": _vote((c["n_words"] >= 50) & (5 * c["n_distinct"] < expected), (c["n_words"] >= 20) & (5 * c["n_distinct"] > 2 * expected)),
        "ends": _vote((c["n_lines"] > 3) & (c["n_ended"] == 0), (c["n_lines"] > 0) & (2 * c["n_ended"] >= c["n_lines"])),
    }


@dataclass(frozen=True)
class VoteModel:
    """Share of each class, the first being the good ones, and for each rule its chance of a bad vote in each class."""

    shares: tuple[float, ...]
    faults: dict[str, tuple[float, ...]]

    def weight(self, name: str, k: int, vote: int) -> float:
        chance = self.faults[name][k]
        return 0.0 if vote == ABSTAIN else math.log(chance if vote == BAD else 1 - chance)

    def posterior(self) -> Column:
        """The probability that a document with the votes in the array `votes` is good."""
        likely = []
        for k, share in enumerate(self.shares):
            weights = F.array(*[F.array(*[F.lit(self.weight(x, k, v)) for v in (ABSTAIN, GOOD, BAD)]) for x in self.faults])
            total = F.aggregate(F.zip_with("votes", weights, lambda v, w: F.get(w, v)), F.lit(math.log(share)), lambda t, x: t + x)
            likely.append(F.exp(total))
        return F.get(F.array(*likely), F.lit(0)) / F.aggregate(F.array(*likely), F.lit(0.0), lambda t, x: t + x)


def estimate(patterns: dict[tuple[int, ...], int], names: list[str]) -> VoteModel:
    """Expectation-maximisation over counted vote patterns."""
    weight = PRIOR_SHARE * max(1, sum(patterns.values()))
    n = len(names)
    shares = (PRIOR_GOOD, *[(1 - PRIOR_GOOD) / n] * n)
    prior = {x: (BLAMES_GOOD, *(FINDS_OWN if j == k else FINDS_OTHER for k in range(n))) for j, x in enumerate(names)}
    model = VoteModel(shares, prior)
    for _ in range(ROUNDS):
        weights = [[[model.weight(x, k, v) for v in (ABSTAIN, GOOD, BAD)] for x in names] for k in range(n + 1)]
        total = [weight * s for s in shares]
        cast = {x: [weight * s for s in shares] for x in names}
        bad = {x: [weight * s * p for s, p in zip(shares, prior[x])] for x in names}
        for pattern, count in patterns.items():
            logs = [math.log(s) + sum(w[v] for w, v in zip(own, pattern)) for s, own in zip(model.shares, weights)]
            top = max(logs)
            parts = [math.exp(x - top) for x in logs]
            whole = sum(parts)
            for k, part in enumerate(parts):
                part *= count / whole
                total[k] += part
                for v, x in zip(pattern, names):
                    if v != ABSTAIN:
                        cast[x][k] += part
                        bad[x][k] += part * (v == BAD)
        everything = sum(total)
        model = VoteModel(tuple(t / everything for t in total), {x: tuple(b / c for b, c in zip(bad[x], cast[x])) for x in names})
    return model


def fit(rows: DataFrame) -> VoteModel:
    """The model of the votes of rows."""
    counted = rows.groupBy("votes").count().collect()  # a row for each pattern
    return estimate({tuple(r["votes"]): r["count"] for r in counted}, list(votes()))


def voted(docs: DataFrame, *drop: str) -> DataFrame:
    """Stored docs with figures and the array of votes."""
    return stored(figures(docs).withColumn("votes", F.array(*votes().values())).drop(*drop), "figures")


def judge(rows: DataFrame, model: VoteModel) -> DataFrame:
    """Rows with base_failed, posterior and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = rows.withColumn("base_failed", failed).withColumn("posterior", model.posterior())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, the figures, base_failed, posterior, kept) of docs (doc_id, text)."""
    rows = voted(docs.select("doc_id", "text"), "text")
    return judge(rows, fit(rows))


def good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    columns = docs.columns
    named = docs.select(F.struct(*columns).alias("_row"), F.col("text"))
    rows = voted(named, "text")
    return judge(rows, fit(rows)).where("kept").select(*[F.col("_row")[c].alias(c) for c in columns])
