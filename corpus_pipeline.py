"""A training-corpus pipeline of five operators. Counted as part of tagloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run applies them to the documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, jaccard_join, mixing, quality, substring_dedup
from tagloom.llm.common import cut, read
from tagloom.llm.queries import OTHER_TARGET, TARGETS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Up to so many repeated ids are broadcast; more are joined by a shuffle.
MOST_REPEATED = 100_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules or the outlier test of their language and source reject go."""
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text", "lang", "source").alias("_key"))
    kept = quality.quality_verdicts(keyed, carry=("_key",)).where("kept").select("_key")
    return keyed.join(kept, "_key", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by n-gram Jaccard similarity stays.

    That of the smallest id that only one row has; in a group without one, that of the smallest hash of all columns. Rows that share
    an id, or have none, are rows of their own, so none is lost for its id; rows equal in all columns are one.
    """
    rows = docs.select(*COLUMNS)
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or doc_id is null").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again"))
    again = cut(again)
    again = F.broadcast(again) if again.count() <= MOST_REPEATED else again  # texts are not shuffled for the few ids that repeat
    # keys of such rows lie above all others: 2^62 and a hash of 62 bits
    own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(*COLUMNS), 2)
    keyed = rows.join(again, rows["doc_id"].eqNullSafe(again["_id"]), "left").withColumn("_key", F.when(F.col("_again"), own).otherwise(F.col("doc_id").cast("bigint"))).drop("_id", "_again")
    groups = jaccard_join.link_documents(keyed, id_col="_key")
    first = groups.where("_key = component_id").select("_key")
    return keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the texts; rows of which nothing is left go.

    Null texts become empty and stay; rows of one id do not cut each other; a null id is later than all others.
    """
    out = substring_dedup.remove_repeated_passages(docs.select(*COLUMNS), carry=("lang", "source"))
    left = out.where("n_removed = 0 or n_removed < n_words")
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows replicated to the target weights and shuffled globally; copies share their doc_id.

    A null source is one of the others; rows that share an id are drawn alike.
    """
    return mixing.mix(docs.select(*COLUMNS), TARGETS, other_weight=OTHER_TARGET).select(*COLUMNS)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the text that they decode to; a null or empty text has none and decodes to an empty one."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", source_mixing),
    ("BPE encoding and decoding", bpe_round_trip),
]

#: Robust estimates and merge tables are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
