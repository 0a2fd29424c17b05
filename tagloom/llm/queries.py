"""The registered queries of this subpackage: each operator over its whole table, and oracle SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, jaccard_join, langid, mixing, quality, substring_dedup, tokens, toxicity, winnow
from .common import crc_mod, read

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Target weights of operator 7 by source; each other source weighs OTHER_TARGET.
TARGETS = {"src0": 3.0, "src1": 2.0, "src2": 0.5}
OTHER_TARGET = 1.0


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_passages(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = langid.identify_languages(docs, docs.where(crc_mod("doc_id", 4) != 2))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the documents are replicated and shuffled; the digest stands for the text."""
    out = mixing.mix(read(spark, sf_dir, "documents"), TARGETS, other_weight=OTHER_TARGET)
    return out.select("doc_id", "source", "copy", "shuffle_key", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_with_edits(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    learnt = crc_mod("doc_id", 3) != 1
    out = toxicity.score_toxicity(docs, docs.where(learnt), labels.where(learnt))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_html_extraction, op3_language_id, op4_token_counts, op5_quality_rules, op6_bpe_round_trip, op7_source_mixing, op8_winnowing, op9_toxicity, op10_jaccard_join)}

#: Operators 2, 3, 4, 5, 6, 8 and 9 rest on parsers, tokenizer libraries, fitted models or hashes that DuckDB
#: lacks; tests/llm holds them against brute force, exact round trips or held-out accuracy.
ORACLE_SQL = {
    "op1_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
        s AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i+12], ' ')) AS least FROM p),
        c AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM s WHERE least < doc_id GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN c USING (doc_id)""",
    "op7_source_mixing": f"""
        WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        w AS (SELECT source, n, CASE source {' '.join(f"WHEN '{s}' THEN {x}" for s, x in TARGETS.items())} ELSE {OTHER_TARGET} END AS w FROM n),
        r0 AS (SELECT source, w / (SELECT sum(w) FROM w) * (SELECT sum(n) FROM w) / n AS rate FROM w),
        r AS (SELECT source, greatest(ceil(rate / 64), 1)::BIGINT AS parts, rate / greatest(ceil(rate / 64), 1) AS rate FROM r0),
        cdf AS (SELECT source, list(c ORDER BY k) AS cs FROM (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM r, range(0, 190) t(k)) GROUP BY source),
        u AS (SELECT doc_id, d.source, text, list_transform(range(parts), lambda p: ('0x' || substr(md5('{mixing.SEED}|copies|' || coalesce(doc_id::VARCHAR, 'null') || CASE WHEN p = 0 THEN '' ELSE '|' || p END), 1, 12))::BIGINT / 281474976710656.0) AS us
              FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
        m AS (SELECT u.doc_id, u.source, u.text, list_sum(list_transform(us, lambda x: len(list_filter(cs, lambda c: c <= x))))::BIGINT AS copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source)
        SELECT doc_id, source, copy::INTEGER AS copy, substr(md5('{mixing.SEED}|order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy), 1, 16) AS shuffle_key, sha256(coalesce(text, '')) AS text_sha256
        FROM (SELECT *, unnest(range(0, copies)) AS copy FROM m)""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({LOWER}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
              FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
              GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
        reach(node, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id FROM d LEFT JOIN n USING (doc_id)
        JOIN (SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY node) r USING (doc_id)""",
}
