"""Span-F1 reward of completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X


def reward_f1(tp: Column, n_gold: Column, n_pred: Column) -> Column:
    """F1 in which nothing predicted where nothing is gold scores one."""
    p = F.when(n_pred > 0, tp / F.greatest(n_pred, F.lit(1))).when(n_gold == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r = F.when(n_gold > 0, tp / F.greatest(n_gold, F.lit(1))).otherwise(F.lit(1.0))
    return F.when(p + r > 0, 2 * p * r / F.greatest(p + r, F.lit(1e-300))).otherwise(F.lit(0.0))


def completion_text(completion: Column, chat: bool = False) -> Column:
    """A completion given as text, or as a list of messages of which the first counts."""
    return F.get(completion, F.lit(0))["content"] if chat else completion


def score(rows: DataFrame, relaxed: bool = True) -> DataFrame:
    """Adds reward to rows of completion, gold_tagged, names, source_text; 0 where the answer alters the source."""
    a = rows.withColumn("_g", S.parse_any("gold_tagged", "names")).withColumn("_p", S.parse_any(X.strip_think_end(F.col("completion")), "names"))
    if relaxed:
        tp = S.relaxed_match_count("_g.spans", "_p.spans")
    else:
        tp = F.size(F.array_intersect("_g.spans", "_p.spans"))
    f1 = reward_f1(tp, F.size("_g.spans"), F.size("_p.spans"))
    return a.withColumn("reward", F.when(F.col("_p.text") == F.col("source_text"), f1).otherwise(F.lit(0.0))).drop("_g", "_p")
