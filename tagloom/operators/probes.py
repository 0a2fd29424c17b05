"""Requests for labels that a text lacks but whose neighbours it holds, and scores of a probe set by what each probe tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.sampling import draw
from .mixture import present_labels, strings
from .scoring import prf, sum_columns, tallied


def edge_labels(present: Column, chain: list[str]) -> Column:
    """Labels of a chain that are absent and lie beside a present one, in the chain's order."""
    label, held = strings(chain), lambda x: F.coalesce(F.array_contains(present, x), F.lit(False))
    beside = lambda i: F.when(i > 0, held(F.get(label, i - 1))).otherwise(F.lit(False)) | F.when(i < len(chain) - 1, held(F.get(label, i + 1))).otherwise(F.lit(False))
    return F.filter(label, lambda x, i: ~held(x) & beside(i))


def containment_negatives(rows: DataFrame, chains: list[list[str]], seed: int) -> DataFrame:
    """row_id, chain, asked, messages: requests that a text can only answer by abstaining.

    For every row (row_id, text, spans) and every chain of labels, each contained in or akin to the next, of which the row holds
    some: one absent label beside a present one, by seeded draw, is all that is asked, and the target is the text itself. Rows that hold
    no label of a chain, or all of it, give none; null spans hold none; a null text gives none. Narrow: no shuffle.
    """
    present = F.coalesce(present_labels(F.col("spans")), strings([]))
    a = rows.where(F.col("text").isNotNull()).select("row_id", "text", present.alias("_present"))
    edges = F.array(*[F.struct(F.lit(k).alias("chain"), edge_labels(F.col("_present"), c).alias("edge")) for k, c in enumerate(chains)])
    a = a.select("row_id", "text", F.explode(edges).alias("_e")).where(F.size("_e.edge") > 0)
    pick = F.pmod(draw(seed, F.col("row_id"), "edge", F.col("_e.chain")), F.size("_e.edge")).cast("int")
    a = a.select("row_id", "text", F.col("_e.chain").alias("chain"), F.get("_e.edge", pick).alias("asked"))
    return a.select("row_id", "chain", "asked", X.chat(X.render_request(F.array(X.slug_words(F.col("asked"))), F.col("text")), F.col("text")).alias("messages"))


def by_axis(parsed: DataFrame, axes: DataFrame) -> DataFrame:
    """axis, rows, bad, absent, abstained, tp, fp, fn, p, r, f1 of parsed rows, by the axis (row_id, axis) that each probe tests.

    absent counts rows without gold spans, and abstained those of them whose sound output has no span either. Matches are exact, bad
    rows missed; rows that axes lacks count under a null axis.
    """
    absent = F.size("gold") == 0
    t = tallied(parsed).select("row_id", "bad", absent.alias("_absent"), (absent & F.col("bad").isNull() & (F.coalesce(F.size("pred"), F.lit(0)) == 0)).alias("_abstained"), "exact")
    t = t.join(axes.select("row_id", "axis"), "row_id", "left").groupBy("axis").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("bad").isNotNull()).alias("bad"), F.count_if("_absent").alias("absent"), F.count_if("_abstained").alias("abstained"), *sum_columns("exact."),
    )
    return t.select("axis", "rows", "bad", "absent", "abstained", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn"))).orderBy("axis")
