"""Snippets: the stretch of a text that holds most of the query's terms, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LENGTH, LEAD = 300, 60
#: White space, also the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1C-\x1F]"


def dense(text: Column) -> Column:
    """Lower-cased, without white space."""
    return F.lower(F.regexp_replace(text, SPACE, ""))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often it stands in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(text: Column, wanted: Column) -> Column:
    """Places, from 0, of the terms in the text: as they are, else with white space left out of the text."""
    # the place in the text of each character that isn't white space; worked out only where a term needs it
    # printable ASCII is told from white space without a pattern
    shown = lambda c: ((c > " ") & (c <= "~")) | ~c.rlike(SPACE)
    solid = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(shown(c), i)), lambda i: i.isNotNull())

    def found(x: Column) -> Column:
        needed = F.exists(wanted, lambda t: ~F.contains(x["low"], t) & F.contains(x["tight"], t))
        return _once(F.when(needed, solid), lambda s: F.transform(wanted, lambda t: place(x, s, t)))

    def place(x: Column, s: Column, term: Column) -> Column:
        at, within = F.position(term, x["low"]), F.position(term, x["tight"])
        return F.when(at > 0, at - 1).when(within > 0, F.get(s, F.least(within, F.size(s)) - 1))

    return F.filter(_once(F.struct(F.lower(text).alias("low"), dense(text).alias("tight")), found), lambda p: p.isNotNull())


def snippet(text: Column, wanted: Column) -> Column:
    """The stretch with most of the terms, which hold no white space, the earliest of equals, from LEAD characters before its
    term; white space squeezed."""

    def held(part: Column) -> Column:
        both = F.struct(F.lower(part).alias("low"), dense(part).alias("tight"))
        return _once(both, lambda x: F.size(F.filter(wanted, lambda t: F.contains(x["low"], t) | F.contains(x["tight"], t))))

    starts = F.array_distinct(F.transform(_places(text, wanted), lambda p: F.greatest(p - LEAD, F.lit(0))))
    best = F.array_max(F.transform(starts, lambda s: F.struct(held(F.substr(text, s + 1, F.lit(LENGTH))).alias("n"), (-s).alias("before"))))
    return _once(best, lambda b: F.trim(F.regexp_replace(F.substr(text, F.coalesce(-b["before"], F.lit(0)) + 1, F.lit(LENGTH)), SPACE + "+", " ")))


def with_snippets(rows: DataFrame) -> DataFrame:
    """Rows (query, title, text, ...) with the column snippet; an empty text gets a note that names query and title. Rows are dealt out
    by query and text first: the long texts that most queries find would else be searched for all of them in the task that read them."""
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query", F.xxhash64("text"))
    note = F.concat(F.lit("No passage for '"), F.col("query"), F.lit("' found in the text. Only the title matches: "), F.col("title"))
    own = rows.withColumn("_wanted", F.array_distinct(T.terms("query")))
    return own.withColumn("snippet", F.when(F.coalesce("text", F.lit("")) != "", snippet(F.col("text"), F.col("_wanted"))).otherwise(note)).drop("_wanted")
