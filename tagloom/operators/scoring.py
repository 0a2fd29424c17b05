"""Scoring of tagged predictions against gold: positional join, parse, exact and relaxed matches, tallies.

Spans stay in arrays beside their document: a row's exact matches are counted per label, and its relaxed ones, in one Arrow
pass over the row. What is exploded and shuffled are sums by label or source, by one two-phase aggregation over few keys.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spans as S
from ..functions import text as X
from ..functions.labels import canonical
from ..functions.sliced import sliced


def positional_join(gold: DataFrame, pred: DataFrame, key: str = "row_id") -> DataFrame:
    """Gold row i beside prediction row i. A row that only one side has raises when it is met, so none is lost silently."""
    both = gold.withColumn("_gold", F.lit(True)).join(pred.withColumn("_pred", F.lit(True)), key, "full")
    lone = F.raise_error(F.concat(F.lit("prediction rows != gold rows, at row "), F.col(key).cast("string"))).cast("boolean")
    return both.where(F.when(F.col("_gold") & F.col("_pred"), F.lit(True)).otherwise(lone)).drop("_gold", "_pred")


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall, F1; 0 wherever a denominator is 0."""
    p = F.when(tp + fp > 0, tp / F.greatest(tp + fp, F.lit(1))).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / F.greatest(tp + fn, F.lit(1))).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / F.greatest(p + r, F.lit(1e-300))).otherwise(F.lit(0.0))
    return [p.alias("p"), r.alias("r"), f.alias("f1")]


def parsed_rows(rows: DataFrame, maps: dict) -> DataFrame:
    """row_id, source, text, bad (null, malformed or copy_drift), gold and pred (canonical spans) from row_id, source, messages, output.

    A gold row that does not parse raises when it is read, as a broken gold file should. A null output parses as an empty one; output goes to the
    parser as it is, so where it is the target itself one parse serves both.
    """
    user, target = F.get("messages", F.lit(1))["content"], F.get("messages", F.lit(2))["content"]
    a = rows.select("row_id", F.col("source"), X.request_text(user).alias("text"), X.request_names(user).alias("names"), target.alias("target"), "output")
    b = a.withColumn("g", S.parse("target", "names")).withColumn("p", S.parse("output", "names"))
    name = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), canonical(F.col("source"), s["label"], maps).alias("label"))
    bad = F.when(F.col("p.reason").isNotNull(), F.lit("malformed")).when(F.col("p.text") != F.col("text"), F.lit("copy_drift"))
    gold = F.when(F.col("g.reason").isNotNull(), F.raise_error(F.concat(F.lit("malformed gold: "), F.col("g.reason"))).cast("array<struct<start:int,end:int,label:string>>")).otherwise(F.transform("g.spans", name))
    return b.select("row_id", "source", "text", bad.alias("bad"), gold.alias("gold"), F.transform("p.spans", name).alias("any_pred")).withColumn("pred", F.when(F.col("bad").isNull(), F.col("any_pred")))


_COUNTS = [T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn")]
_TALLY = T.StructType([T.StructField("labels", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), *_COUNTS]))), T.StructField("relaxed", T.LongType())])


@sliced(_TALLY)
def _tally(gold, pred):
    """Of each row: exact multiset matches by label, in order of appearance, and the number of relaxed ones."""

    def labels(gold, pred):
        g, p = (Counter((s["start"], s["end"], s["label"]) for s in spans) for spans in (gold, pred))
        out = {label: [0, 0, 0] for *_, label in [*g, *p]}
        for span in g | p:
            hit = min(g[span], p[span])
            for k, n in enumerate((hit, p[span] - hit, g[span] - hit)):
                out[span[2]][k] += n
        return [{"label": label, "tp": tp, "fp": fp, "fn": fn} for label, (tp, fp, fn) in out.items()]

    pairs = [[x if x is not None else () for x in pair] for pair in zip(gold, pred, strict=True)]
    return [{"labels": labels(*x), "relaxed": S.relaxed_count(*x)} for x in pairs]


def tallied(parsed: DataFrame) -> DataFrame:
    """parsed_rows with labels (exact tp, fp, fn of each label), exact and relaxed (tp, fp, fn); all gold of a bad row is missed."""
    a = parsed.withColumn("_t", _tally("gold", "pred"))
    total = lambda c: F.aggregate(F.col("_t.labels"), F.lit(0).cast("bigint"), lambda n, x: n + x[c]).alias(c)
    hit, n_pred = F.col("_t.relaxed"), F.coalesce(F.size("pred"), F.lit(0))
    relaxed = F.struct(hit.alias("tp"), (F.when(F.col("bad").isNull(), n_pred).otherwise(F.lit(0)) - hit).alias("fp"), (F.size("gold") - hit).alias("fn"))
    return a.select(*parsed.columns, F.col("_t.labels").alias("labels"), F.struct(*map(total, ("tp", "fp", "fn"))).alias("exact"), relaxed.alias("relaxed"))


def sum_columns(of: str = "", where: Column | None = None, to: str = "") -> list[Column]:
    value = lambda c: F.col(f"{of}{c}") if where is None else F.when(where, F.col(f"{of}{c}"))
    return [F.coalesce(F.sum(value(c)), F.lit(0)).cast("bigint").alias(f"{to}{c}") for c in ("tp", "fp", "fn")]


def _ops() -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("bad") == "malformed").alias("malformed"), F.count_if(F.col("bad") == "copy_drift").alias("copy_drift"), F.lit(0).cast("bigint").alias("unrequested_tags")]


def ops_counters(parsed: DataFrame) -> DataFrame:
    """rows, malformed, copy_drift, and unrequested_tags, which is always 0."""
    return parsed.agg(*_ops())


TALLIES = ("strict_exact", "strict_relaxed", "parseable_exact", "parseable_relaxed")


def summary(parsed: DataFrame) -> DataFrame:
    """One row: the operation counters, and tp, fp, fn of every tally as {tally}_{count}; one aggregation over one evaluation of the rows."""
    sums = []
    for tally in TALLIES:
        rows, mode = tally.split("_")
        sums += sum_columns(f"{mode}.", F.col("bad").isNull() if rows == "parseable" else None, f"{tally}_")
    return tallied(parsed).agg(*_ops(), *sums)


def micro(parsed: DataFrame) -> DataFrame:
    """One row per tally: strict_exact, strict_relaxed, parseable_exact, parseable_relaxed."""
    each = ", ".join(f"'{t}', {t}_tp, {t}_fp, {t}_fn" for t in TALLIES)
    return summary(parsed).selectExpr(f"stack({len(TALLIES)}, {each}) AS (tally, tp, fp, fn)").select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def by_label(parsed: DataFrame, supported_only: bool = False) -> DataFrame:
    """label, support, tp, fp, fn, p, r, f1 of exact strict matches; worst first, equal ones in order of their first row."""
    t = tallied(parsed).select("row_id", F.posexplode("labels").alias("pos", "t")).select("row_id", "pos", "t.*")
    t = t.groupBy("label").agg(*sum_columns(), F.min(F.struct("row_id", "pos")).alias("first"))
    t = t.where("tp + fn > 0") if supported_only else t
    return t.select("label", (F.col("tp") + F.col("fn")).alias("support"), "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")), "first").orderBy("f1", "first").drop("first")


def by_source(parsed: DataFrame) -> DataFrame:
    """source, rows (bad ones too), tp, fp, fn, p, r, f1 of exact strict matches; by name."""
    t = tallied(parsed).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), *sum_columns("exact."))
    return t.select("source", "rows", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn"))).orderBy("source")


def metrics(parsed: DataFrame) -> dict:
    """All metrics as the nested document that the JSON sink writes; a few rows reach the driver."""
    parsed = parsed.cache()
    ops = ops_counters(parsed).first().asDict()
    tallies = {r["tally"]: {"p": r["p"], "r": r["r"], "f": r["f1"]} for r in micro(parsed).collect()}
    labels = {r["label"]: {"p": r["p"], "r": r["r"], "f": r["f1"], "support": r["support"]} for r in by_label(parsed).collect()}
    parsed.unpersist()
    return {"ops": ops, **{k: tallies[k] for k in ("strict_exact", "strict_relaxed", "parseable_exact")}, "per_label": labels}


def report_lines(parsed: DataFrame) -> list[str]:
    """A fixed-width text report."""
    parsed = parsed.cache()
    ops = ops_counters(parsed).first()
    n = max(1, ops["rows"])
    lines = [f"rows                  {ops['rows']}", f"malformed output      {ops['malformed']} ({ops['malformed'] / n:.1%})", f"copy drift            {ops['copy_drift']} ({ops['copy_drift'] / n:.1%})", ""]
    t = {r["tally"]: r for r in micro(parsed).collect()}
    for title, kind in (("all rows, bad ones missed:", "strict"), ("sound rows only:", "parseable")):
        lines.append(title)
        for mode, note in (("exact", ""), ("relaxed", "  any overlap")):
            r = t[f"{kind}_{mode}"]
            lines.append(f"  {mode:<7} P {r['p']:.3f}  R {r['r']:.3f}  F1 {r['f1']:.3f}{note}")
    lines += ["", "sources, by exact matches over all rows:"]
    lines += [f"  {r['source']:<10} rows {r['rows']:>6}  P {r['p']:.3f}  R {r['r']:.3f}  F1 {r['f1']:.3f}" for r in by_source(parsed).collect()]
    lines += ["", "labels, lowest F1 first:"]
    lines += [f"  {r['label']:<45} support {r['support']:>5}  P {r['p']:.3f}  R {r['r']:.3f}  F1 {r['f1']:.3f}" for r in by_label(parsed, supported_only=True).collect()]
    parsed.unpersist()
    return lines


def self_test(rows: DataFrame, maps: dict) -> DataFrame:
    """Gold scored against itself: ok is true if all is 1 and no row is bad."""
    parsed = parsed_rows(rows.withColumn("output", F.get("messages", F.lit(2))["content"]), maps)
    perfect = (F.col("strict_exact_tp") > 0) & (F.col("strict_exact_fp") + F.col("strict_exact_fn") + F.col("malformed") + F.col("copy_drift") == 0)
    return summary(parsed).select("rows", perfect.alias("ok"))
