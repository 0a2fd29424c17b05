"""Classification of span errors: exact, boundary, label_swap, miss for gold; spurious for predictions.

Malformed rows are skipped, drifted ones are not. Events are found in the arrays of each row, without a join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import spans as S

_EVENT = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("other_start", T.IntegerType()), T.StructField("other_end", T.IntegerType())]))


@F.pandas_udf(_EVENT)
def row_events(gold: pd.Series, pred: pd.Series) -> pd.Series:
    def events(g, p):
        g, p = list(g), list(p)
        exact = {(x["start"], x["end"], x["label"]) for x in p}
        out = []
        for x in g:
            here = (x["start"], x["end"])
            touching = [y for y in p if y["start"] < x["end"] and x["start"] < y["end"]]
            same = [y for y in touching if y["label"] == x["label"]]
            kind, other = ("exact", None) if (*here, x["label"]) in exact else ("boundary", same[0]) if same else ("label_swap", touching[0]) if touching else ("miss", None)
            out.append({"label": x["label"], "kind": kind, "start": here[0], "end": here[1], "other_start": other and other["start"], "other_end": other and other["end"]})
        for y in p:
            if not any(x["label"] == y["label"] and y["start"] < x["end"] and x["start"] < y["end"] for x in g):
                out.append({"label": y["label"], "kind": "spurious", "start": y["start"], "end": y["end"], "other_start": None, "other_end": None})
        return out

    return pd.Series([events(a, b) for a, b in zip(gold, pred, strict=True)])


def error_events(parsed: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """row_id, text, label, kind, start, end, other_start, other_end of scoring.parsed_rows; only the labels asked for."""
    rows = parsed.where("bad is null or bad <> 'malformed'").select("row_id", "text", row_events("gold", "any_pred").alias("e"))
    out = rows.select("row_id", "text", F.posexplode("e").alias("pos", "e")).select("row_id", "pos", "text", "e.*")
    return out.where(F.col("label").isin(labels)) if labels else out


def error_counts(events: DataFrame) -> DataFrame:
    """label, exact, boundary, miss, label_swap, spurious; by label."""
    kinds = ["exact", "boundary", "miss", "label_swap", "spurious"]
    return events.groupBy("label").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds]).orderBy("label")


def error_examples(events: DataFrame, k: int = 8) -> DataFrame:
    """The first k events of every label and kind but exact, with what was meant, what was read and their context."""
    w = Window.partitionBy("label", "kind").orderBy("row_id", "pos")
    top = events.where("kind <> 'exact'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    body = lambda a, b: F.substring(F.col("text"), F.col(a) + 1, F.col(b) - F.col(a))
    both = F.col("other_start").isNotNull()
    first = F.least("start", F.coalesce("other_start", "start"))
    low = F.greatest(first - 30, F.lit(0))
    context = F.when(both, F.substring(F.col("text"), low + 1, first - low)).otherwise(S.snippet(F.col("text"), F.col("start"), F.col("end")))
    gold = F.when(F.col("kind") != "spurious", body("start", "end"))
    pred = F.when(F.col("kind") == "spurious", body("start", "end")).when(both, body("other_start", "other_end"))
    return top.select("label", "kind", "rank", "row_id", gold.alias("gold"), pred.alias("pred"), context.alias("context"))
