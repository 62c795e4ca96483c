"""The queries of this folder, each over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, lexical_search, line_dedup, lm_score, mixing, quality_rules, sentencepiece_bpe, substring_dedup, token_alignment, token_orc, url_filter, warc
from .common import fresh_path, table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"), min_bytes=0)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.cluster(table(spark, sf_dir, "documents"), shingle=3, p=90, q=100)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), order=2)

#: The rules of the query.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = fresh_path(spark, "tokens")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    token_orc.write_orc(token_orc.encode_sorted(docs, BYTE_BPE, end_id=2, files=files), path)
    return token_orc.checksums(token_orc.positions(spark, path))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.report(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, PIECE_MODEL), PIECE_MODEL)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5, most=2.0).drop("source")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_MODEL, digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_warc": op2_warc, "op3_ngram_jaccard": op3_ngram_jaccard, "op4_lm_score": op4_lm_score, "op5_token_orc": op5_token_orc, "op6_url_filter": op6_url_filter, "op7_line_dedup": op7_line_dedup, "op8_quality_rules": op8_quality_rules, "op9_substring_dedup": op9_substring_dedup, "op10_sentencepiece": op10_sentencepiece, "op11_mix_sources": op11_mix_sources, "op12_lexical_search": op12_lexical_search, "op13_token_alignment": op13_token_alignment}
ORACLES: dict[str, str] = {
    "op1_decontaminate": r"""
        WITH wd AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        wi AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS k
                FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM (SELECT *, least(10, len(w)) AS n FROM wi WHERE len(w) > 0))),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
               FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM wd, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        met AS (SELECT doc_id, item_id, n, i FROM dw JOIN win USING (n, k)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY 1),
        own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM wd LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)""",
    "op3_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
        reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.c)
        SELECT doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op9_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
        f AS (SELECT h, min(doc_id) AS m FROM s GROUP BY h),
        g AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM s JOIN f USING (h) WHERE m < doc_id) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN g USING (doc_id)""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT *, translate(concat(
                to_base(('0x' || substr(h, 1, 10))::BIGINT, 32, 8), to_base(('0x' || substr(h, 11, 10))::BIGINT, 32, 8),
                to_base(('0x' || substr(h, 21, 10))::BIGINT, 32, 8), to_base(('0x' || substr(h, 31, 10))::BIGINT, 32, 8)),
                '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS digest,
              max(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d""",
    "op11_mix_sources": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS tie FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, list_extract([3, 1, 2], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT)::DOUBLE AS w FROM d GROUP BY source),
        -- weights share what is left among the sources that are not at their bounds, until none is above
        f AS (SELECT 0 AS step, source, w, 2.0::DOUBLE * source_size AS bound, (1.5::DOUBLE * sum(source_size) OVER ())::DOUBLE AS left_over, false AS at_bound FROM s
              UNION ALL SELECT step + 1, source, w, bound, sum(CASE WHEN full_ AND NOT at_bound THEN -bound ELSE 0 END) OVER () + left_over, full_
              FROM (SELECT *, at_bound OR left_over / sum(CASE WHEN at_bound THEN 0 ELSE w END) OVER () * w > bound AS full_ FROM f) WHERE step < 60),
        t AS (SELECT source, CASE WHEN at_bound THEN bound ELSE left_over / sum(CASE WHEN at_bound THEN 0 ELSE w END) OVER () * w END AS target FROM f WHERE step = 60),
        p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size END AS rate,
                     ('0x' || substr(md5('1:' || coalesce('s' || source, '')), 1, 6))::BIGINT::DOUBLE / 16777216 AS o, (SELECT ceil(sqrt(max(docs)))::BIGINT FROM s) AS slices,
                     greatest(length(bin(size)) - 8, 0) AS power FROM d JOIN s USING (source) JOIN t USING (source)),
        n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY power * 128 + (size >> power::INT), ('0x' || substr(tie, 1, 8))::BIGINT % slices, size, doc_id, tie) AS i FROM p)
        SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM (
            SELECT *, coalesce(least(floor(o + rate * i) - floor(o + rate * (i - 1)), ceil(rate)), 0)::BIGINT AS copies FROM n)""",
    "op12_lexical_search": r"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        a AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM t WHERE len(w) > 0),
        p AS (SELECT d, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT d, doc_id, w, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, a GROUP BY term, n_docs),
        s AS (SELECT item_id, d, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_words))))::BIGINT AS score
              FROM q JOIN p USING (term) JOIN f USING (term), a GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
}
