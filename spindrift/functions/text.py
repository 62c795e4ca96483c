"""Text functions as Column expressions: terms, collapsed text, title and body scores, versions, document types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a term is a run of ASCII letters, digits and underscores, or of Hangul syllables.
TERM = r"[0-9A-Za-z_]+|[가-힣]+"
ASCII_TERM = r"[A-Za-z0-9_]+"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def terms(text: Column | str, pattern: str = TERM) -> Column:
    """Lower-cased terms in order. Letters outside the pattern separate terms."""
    return F.transform(F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(0)), lambda t: F.lower(t))


def collapse(text: Column | str) -> Column:
    """Lower-cased, without any Unicode white space."""
    return F.lower(F.regexp_replace(_text(text), r"(?U)\s+", ""))


def collapse_spaces(text: Column | str) -> Column:
    """Lower-cased, without U+0020: what the substring filter of the title arm compares."""
    return F.lower(F.replace(_text(text), F.lit(" "), F.lit("")))


def overlap_share(query_terms: Column, haystack_terms: Column) -> Column:
    """Share of the distinct query terms found; 0 if there are none."""
    wanted = F.array_distinct(query_terms)
    shared = F.size(F.array_intersect(wanted, haystack_terms))
    return F.when(F.size(wanted) > 0, shared / F.size(wanted)).otherwise(0.0)


def collapsed_share(query: Column, query_terms: Column, haystack: Column) -> Column:
    """What one term is worth, if the collapsed query is within the collapsed haystack; else 0."""
    n = F.size(F.array_distinct(query_terms))
    hit = (collapse(query) != "") & F.contains(haystack, collapse(query))
    return F.when(hit & (n > 0), F.lit(1.0) / n).otherwise(0.0)


def title_score(query: Column, query_terms: Column, title: Column, url: Column) -> Column:
    both = F.array_union(terms(title), terms(url))
    return F.greatest(overlap_share(query_terms, both), collapsed_share(query, query_terms, F.concat(collapse(title), collapse(url))))


def body_score(query: Column, query_terms: Column, body: Column) -> Column:
    return F.greatest(overlap_share(query_terms, terms(body)), collapsed_share(query, query_terms, collapse(body)))


#: Fixed value: a version within a title.
VERSION = r"(?i)(?<![0-9A-Za-z])v[\s_]?(\d+(?:[._]\d+)*)"


def version(title: Column | str) -> Column:
    """`v` and the last number after a `v` that no letter or digit precedes, `_` as `.`; else null."""
    found = F.regexp_extract_all(_text(title), F.lit(VERSION), F.lit(1))
    return F.concat(F.lit("v"), F.replace(F.try_element_at(found, F.lit(-1)), F.lit("_"), F.lit(".")))


def doc_type(text: Column, url: Column) -> Column:
    """markdown, csv or openapi, by the url's ending, else by how the text begins."""
    link = F.lower(F.coalesce(url, F.lit("")))
    body = F.regexp_replace(_text(text), r"(?U)^\s+", "")
    first_line = F.regexp_extract(body, r"^[^\n\r\x0B\x0C\x1C-\x1E\x85  ]*", 0)
    head = F.substring(body, 1, 200)
    return (
        F.when(link.endswith(".md") | link.endswith(".markdown"), "markdown")
        .when(link.endswith(".csv"), "csv")
        .when(body.startswith("{") | F.contains(head, F.lit("openapi:")) | F.contains(head, F.lit("swagger:")), "openapi")
        .when(F.contains(first_line, F.lit(",")) & ~first_line.startswith("#"), "csv")
        .otherwise("markdown")
    )


def content_hash(text: Column | str) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def stable_id(source: Column, *key: Column) -> Column:
    """`source:` and 16 hex digits of the key's hash."""
    return F.concat(source, F.lit(":"), F.substring(F.sha2(F.concat_ws("\u0000", *key), 256), 1, 16))


def utc(text: Column | str) -> Column:
    """RFC 3339 to a timestamp; null if it is none. Sessions run in UTC."""
    return F.try_to_timestamp(F.regexp_replace(_text(text), "Z$", "+00:00"))


def clean_text(text: Column | str) -> Column:
    return F.replace(_text(text), F.char(F.lit(0)), F.lit(""))
