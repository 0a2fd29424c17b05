"""Converters of annotated corpora: validation of offsets, rejection reasons, tagged rows."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spans as S
from ..schemas import VALUED_SPANS

_LITERAL = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("label", T.StringType())]))


@F.pandas_udf(_LITERAL)
def _literal(raw: pd.Series) -> pd.Series:
    def read(x):
        return None if x is None else [{"start": s["start"], "end": s["end"], "value": None if "text" not in s else str(s["text"]), "label": s["label"]} for s in ast.literal_eval(x)]

    return pd.Series([read(x) for x in raw])


def literal_spans(raw: str):
    """Spans from Python-literal text: parsed as JSON where that reads it whole, else as a literal."""
    fast = F.from_json(F.col(raw), "array<struct<start: int, end: int, text: string, label: string>>", {"allowSingleQuotes": "true"})
    quick = F.transform(fast, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("value"), s["label"].alias("label")))
    whole = F.col(raw).isNotNull() & fast.isNotNull() & ~F.contains(F.col(raw), F.lit("\\")) & F.forall(fast, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & s["label"].isNotNull() & s["text"].isNotNull())
    return F.when(whole, quick).otherwise(_literal(raw))


def plain(spans):
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))


def convert_valued(rows: DataFrame) -> DataFrame:
    """Adds text_xml and reason to rows of text, spans (with value): 'Offset mismatch', 'Overlapping spans' or null."""
    a = rows.withColumn("_ok", S.offsets_valid_loosely("text", F.col("spans").cast(VALUED_SPANS))).withColumn("_i", S.inject("text", plain(F.col("spans"))))
    return a.withColumn("reason", F.when(~F.col("_ok"), F.lit("Offset mismatch")).otherwise(F.col("_i.reason"))).withColumn("text_xml", F.when(F.col("reason").isNull(), F.col("_i.tagged"))).drop("_ok", "_i")


def converted_rows(converted: DataFrame, limit: int | None = None) -> DataFrame:
    """Tagged rows; limit counts the rows that validation and injection leave, not those read."""
    kept = converted.where("reason is null")
    return kept.limit(limit) if limit else kept


def skip_reasons(converted: DataFrame) -> DataFrame:
    return converted.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy("reason")


def convert_masked(rows: DataFrame, language: str = "en") -> DataFrame:
    """Adds first_bad and valid to the rows of one language: exact offsets of every span. Rows without spans are not valid."""
    here = rows.where(F.col("language") == language)
    return here.withColumn("first_bad", S.first_wrong("source_text", "privacy_mask")).withColumn("valid", (F.size("privacy_mask") > 0) & (F.col("first_bad") < 0))


def masked_rows(converted: DataFrame) -> DataFrame:
    return converted.where("valid").select(F.col("source_text").alias("text"), plain(F.col("privacy_mask")).alias("spans"), "uid")


def _checked(converted: DataFrame) -> DataFrame:
    """Spans up to the first one with wrong offsets, and whether there is one."""
    bad = F.col("first_bad") >= 0
    return converted.withColumn("bad", bad).withColumn("seen", F.when(bad, F.slice("privacy_mask", F.lit(1), F.col("first_bad"))).otherwise(F.col("privacy_mask")))


def quality_counters(converted: DataFrame) -> DataFrame:
    """kept rows, rows with bad offsets, one-character spans before the first bad one."""
    c = _checked(converted)
    return c.agg(F.count_if("valid").alias("kept"), F.count_if("bad").alias("bad_offsets"), F.coalesce(F.sum(F.size(F.filter("seen", lambda s: s["end"] - s["start"] == 1))), F.lit(0)).cast("bigint").alias("one_char_spans"))


def label_frequency(converted: DataFrame) -> DataFrame:
    """label, n, most frequent first; spans of rows that are rejected later in the row count."""
    return _checked(converted).select(F.explode("seen.label").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")
