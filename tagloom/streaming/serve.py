"""Tag requests as a table or a stream: normalise, guard, render, tag, check the copy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..operators.tagger import rule_spans

BLANK = "need text and at least one entity type"


def rule_tagger(rows: DataFrame) -> Column:
    """Tags with the rule tagger; a span counts if its label's words are among the names."""
    words = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), X.slug_words(s["label"]).alias("label"))
    wanted = F.filter(F.transform(rule_spans("text"), words), lambda s: F.array_contains(F.col("names"), s["label"]))
    return S.inject("text", wanted)["tagged"]


def tag_requests(requests: DataFrame, tagger: Callable[[DataFrame], Column] = rule_tagger) -> DataFrame:
    """Adds names, prompt, tagged, faithful and error to requests of text, entities, constrained. Works on streams as on tables."""
    a = requests.withColumn("names", X.normal_names(F.coalesce("entities", F.array().cast("array<string>"))))
    a = a.withColumn("error", F.when((F.size("names") == 0) | F.coalesce(F.trim("text") == "", F.lit(True)), F.lit(BLANK)))
    a = a.withColumn("prompt", F.when(F.col("error").isNull(), X.render_request(F.col("names"), F.col("text"))))
    a = a.withColumn("_out", tagger(a))
    a = a.withColumn("tagged", F.when(F.col("error").isNull(), X.strip_think_start(F.col("_out")))).drop("_out")
    return a.withColumn("faithful", F.when(F.col("error").isNull(), S.faithful(F.col("tagged"), F.col("names"), F.col("text"))))


def serve(requests: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, tagger: Callable[[DataFrame], Column] = rule_tagger):
    """Starts a streaming query that tags each micro-batch of requests and hands it to sink."""
    return tag_requests(requests, tagger).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def segments(tagged: Column) -> Column:
    """Pieces of a tagged text for display: alternating plain text and tagged entities."""
    return F.regexp_extract_all(tagged, F.lit(r"(?s)<([^<>/]+)>.*?</\1>|[^<]+|<"), F.lit(0))


def hue(index: Column) -> Column:
    return F.pmod(index, F.lit(12))
