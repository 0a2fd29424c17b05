"""Seeded training mixtures: request plans, alias picks, negative cap, relabelling, rendering, statistics.

Every draw is a pure function of seed, row_id and purpose, so rows are independent and a build is the same on any cluster;
only the negative cap looks at earlier rows, and it runs on a projection of two flags per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..functions.labels import alias_map, families_of
from ..functions.sampling import between, draw, shuffled, uniform

SEED_V1, SEED_V2 = 20260708, 20260719
# Shares of the request kinds, negative caps, share of guided requests, evaluation and source caps.
FULL, WITH_NEGATIVES = 0.40, 0.80
CAP_V1, CAP_V2, LEAST_NEGATIVES = 0.10, 0.08, 20
GUIDED = 0.30
EVAL_CAP, SOURCE_CAP, UPSAMPLE = 2000, 110_000, 3
_NO_STRINGS = "array<string>"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast(_NO_STRINGS) if values else F.array().cast(_NO_STRINGS)


def present_labels(spans: Column) -> Column:
    """Distinct labels of the spans, in order."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"])))


def keep_spans(spans: Column, removed: list[str] = (), known: list[str] | None = None, least: int = 0) -> Column:
    """Spans of labels that are not removed, are known, and have at least so many characters."""

    def keep(s):
        ok = s["end"] - s["start"] >= least
        ok = ok & ~s["label"].isin(list(removed)) if removed else ok
        return ok & s["label"].isin(known) if known is not None else ok

    return F.filter(spans, keep)


def repair_dates(spans: Column, text: Column) -> Column:
    """date_time spans without a clock time become date; digits of any script count."""
    body = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when((s["label"] == "date_time") & ~body(s).rlike(r"(?U)\d{1,2}:\d{2}"), F.lit("date")).otherwise(s["label"]).alias("label")))


def bucket(seed: int, row: Column, present: Column) -> Column:
    """full, negatives or subset."""
    u = uniform(seed, row, "bucket")
    return F.when((u < FULL) | (F.size(present) == 0), F.lit("full")).when(u < WITH_NEGATIVES, F.lit("negatives")).otherwise(F.lit("subset"))


def negatives_v1(seed: int, row: Column, present: Column, vocabulary: list[str], family: list[str]) -> Column:
    """2 to 6 labels without replacement from those not present; one family leaves as a whole if any of it is present."""
    pool = F.array_except(strings(vocabulary), present)
    pool = F.when(F.arrays_overlap(present, strings(family)), F.array_except(pool, strings(family))).otherwise(pool) if family else pool
    return F.slice(shuffled(seed, row, "negative", pool), 1, F.least(between(seed, row, "negatives", 2, F.lit(6)), F.size(pool)))


def subset_v1(seed: int, row: Column, present: Column, family: list[str]) -> Column:
    """present without 1 to n-1 of its units; the family is one unit; all of it if there are fewer than two units."""
    unit = lambda x: F.when(x.isin(family), F.lit("#family")).otherwise(x) if family else x
    units = F.array_distinct(F.transform(present, unit))
    dropped = F.slice(shuffled(seed, row, "drop", units), 1, between(seed, row, "drops", 1, F.size(units) - 1))
    return F.when(F.size(units) < 2, present).otherwise(F.filter(present, lambda x: ~F.array_contains(dropped, unit(x))))


def negatives_v2(seed: int, row: Column, present: Column, vocabulary: list[str], families: list[list[str]]) -> Column:
    """2 to 6 draws with replacement, half of them from the families of present labels; repeats collapse."""
    pool = F.array_except(strings(vocabulary), present)
    related = F.array_intersect(pool, F.flatten(F.transform(present, lambda x: families_of(x, families)))) if families else F.array().cast(_NO_STRINGS)
    k = F.least(between(seed, row, "negatives", 2, F.lit(6)), F.size(pool))

    def pick(i):
        near = (F.size(related) > 0) & (uniform(seed, row, "related", i) < 0.5)
        at = lambda items: F.get(items, F.pmod(draw(seed, row, "negative", i), F.greatest(F.size(items), F.lit(1))).cast("int"))
        return F.when(near, at(related)).otherwise(at(pool))

    return F.when(k > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), pick))).otherwise(F.array().cast(_NO_STRINGS))


def subset_v2(seed: int, row: Column, present: Column) -> Column:
    """present without 1 to n-1 labels; all of it if there are fewer than two."""
    return subset_v1(seed, row, present, [])


def plan_requests(rows: DataFrame, seed: int, vocabulary: list[str], family: list[str] = (), families: list[list[str]] = (), version: int = 1) -> DataFrame:
    """Adds present, bucket, request, target and relabel_birth to rows of row_id, spans."""
    row, present = F.col("row_id"), F.col("present")
    a = rows.withColumn("present", present_labels(F.col("spans"))).withColumn("bucket", bucket(seed, row, present))
    negative = negatives_v1(seed, row, present, vocabulary, list(family)) if version == 1 else negatives_v2(seed, row, present, vocabulary, list(families))
    subset = subset_v1(seed, row, present, list(family)) if version == 1 else subset_v2(seed, row, present)
    a = a.withColumn("target", F.when(F.col("bucket") == "subset", subset).otherwise(present))
    request = F.when(F.col("bucket") == "full", strings(vocabulary)).when(F.col("bucket") == "negatives", shuffled(seed, row, "request", F.concat(present, negative))).otherwise(F.col("target"))
    birth = (F.col("bucket") == "subset") & F.array_contains("present", "date_of_birth") & ~F.array_contains("target", "date_of_birth") & F.array_contains("target", "date") if version == 2 else F.lit(False)
    return a.withColumn("request", request).withColumn("relabel_birth", birth)


def pick_aliases(seed: int, row: Column, request: Column, text: Column, aliases: dict[str, list[str]]) -> Column:
    """One alias per requested label, in order: uniform among those whose tags the text does not hold and no other label took; null where none is left."""
    table = alias_map(aliases)

    def step(taken, label):
        free = F.filter(F.try_element_at(table, label), lambda a: ~F.contains(text, F.concat(F.lit("<"), a, F.lit(">"))) & ~F.contains(text, F.concat(F.lit("</"), a, F.lit(">"))) & ~F.coalesce(F.array_contains(taken, a), F.lit(False)))
        pick = F.get(free, F.pmod(draw(seed, row, "alias", label), F.greatest(F.size(free), F.lit(1))).cast("int"))
        return F.concat(taken, F.array(pick))

    return F.aggregate(request, F.array().cast(_NO_STRINGS), step)


def cap_negatives(rows: DataFrame, cap: float, least: int = LEAST_NEGATIVES) -> DataFrame:
    """source, row_id, kept of rows with source, row_id, negative, emits.

    The k-th negative row of a source, dropped ones counted, is dropped if k exceeds max(least, cap * (rows written before + 1)).
    Whether a row is written depends on all earlier ones, so each source is one ordered pass, in constant memory, over
    this narrow projection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str | None, list[int]] = {}
        for b in batches:
            kept = []
            for source, negative, emits in zip(b.column("source").to_pylist(), b.column("negative").to_pylist(), b.column("emits").to_pylist(), strict=True):
                state = seen.setdefault(source, [0, 0])
                if negative:
                    state[0] += 1
                keep = not negative or state[0] <= max(least, cap * (state[1] + 1))
                state[1] += keep and emits
                kept.append(keep)
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("row_id"), pa.array(kept, pa.bool_())], names=["source", "row_id", "kept"])

    narrow = rows.select("source", F.col("row_id").cast("bigint").alias("row_id"), "negative", "emits")
    return narrow.repartition("source").sortWithinPartitions("source", "row_id").mapInArrow(run, "source string, row_id bigint, kept boolean")


def outcomes(rows: DataFrame, aliases: dict[str, list[str]], vocabulary: list[str], seed: int, version: int = 1, family: list[str] = (), families: list[list[str]] = (), rules: dict[str, str] | None = None, removed: list[str] = ()) -> DataFrame:
    """Every row of (row_id, source, text, spans) with its fate: emitted, negative_dropped, alias_collision or overlap, and its parts."""
    known = list(aliases) if version == 2 else None
    rows = rows.withColumn("spans", keep_spans(F.col("spans"), removed, known, 2 if version == 2 else 0))
    a = plan_requests(rows, seed, vocabulary, family, families, version).withColumn("negative", F.size("target") == 0)
    a = a.withColumn("names", pick_aliases(seed, F.col("row_id"), F.col("request"), F.col("text"), aliases)).withColumn("collides", F.exists("names", lambda n: n.isNull()))
    label = lambda s: F.when(F.col("relabel_birth") & (s["label"] == "date_of_birth"), F.lit("date")).otherwise(s["label"])
    kept = F.transform(F.filter("spans", lambda s: F.array_contains(F.col("target"), label(s))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(F.col("names"), (F.array_position(F.col("request"), label(s)) - 1).cast("int")).alias("label")))
    a = a.withColumn("kept_spans", F.when(~F.col("collides"), kept)).withColumn("overlaps", F.when(~F.col("collides"), S.overlapping(F.col("kept_spans"))).otherwise(F.lit(False)))
    flags = a.select("source", "row_id", "negative", (~F.col("collides") & ~F.col("overlaps")).alias("emits"))
    allowed = cap_negatives(flags, CAP_V1 if version == 1 else CAP_V2)
    a = a.join(allowed, ["source", "row_id"])
    fate = F.when(~F.col("kept"), F.lit("negative_dropped")).when(F.col("collides"), F.lit("alias_collision")).when(F.col("overlaps"), F.lit("overlap")).otherwise(F.lit("emitted"))
    a = a.withColumn("fate", fate)
    if version == 2 and rules:
        table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
        guided = uniform(seed, F.col("row_id"), "guided") < GUIDED
        line = lambda n, i: F.when(guided & F.try_element_at(table, F.get("request", i)).isNotNull(), F.concat(n, F.lit(": "), F.try_element_at(table, F.get("request", i)))).otherwise(n)
        a = a.withColumn("lines", F.transform("names", line))
    else:
        a = a.withColumn("lines", F.col("names"))
    return a.withColumn("lines", shuffled(seed, F.col("row_id"), "line", F.col("lines")))


def examples(planned: DataFrame, split: str | None = None, limit: int | None = None) -> DataFrame:
    """row_id, messages, source (and split) of emitted rows; limit counts emitted rows of each source in row order."""
    rows = planned.where("fate = 'emitted'")
    if limit:
        from pyspark.sql.window import Window

        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("row_id"))).where(F.col("_n") <= limit)
    tagged = rows.withColumn("tagged", S.inject("text", "kept_spans")["tagged"])
    out = tagged.select("row_id", X.chat(X.render_request(F.col("lines"), F.col("text")), F.col("tagged")).alias("messages"), "source")
    return out.withColumn("split", F.lit(split)) if split else out


def statistics(planned: DataFrame) -> DataFrame:
    """source, rows, skip_overlap, skip_alias, neg_rows, neg_dropped, relabeled_subset."""
    count = lambda c: F.count_if(c).cast("bigint")
    relabeled = F.when(F.col("relabel_birth") & F.col("kept") & ~F.col("collides"), F.size(F.filter("spans", lambda s: s["label"] == "date_of_birth"))).otherwise(F.lit(0))
    return planned.groupBy("source").agg(
        count(F.col("fate") == "emitted").alias("rows"), count(F.col("fate") == "overlap").alias("skip_overlap"), count(F.col("fate") == "alias_collision").alias("skip_alias"),
        count(F.col("negative")).alias("neg_rows"), count(F.col("fate") == "negative_dropped").alias("neg_dropped"), F.sum(relabeled).cast("bigint").alias("relabeled_subset"),
    )


def seeded_order(df: DataFrame, seed: int, key: str = "row_id", purpose: str = "shuffle") -> DataFrame:
    """Rows in the order of their draws."""
    return df.orderBy(draw(seed, F.col(key), purpose), key)


def seeded_cap(df: DataFrame, seed: int, n: int, key: str = "row_id", purpose: str = "cap") -> DataFrame:
    """The n rows with the smallest draws."""
    return seeded_order(df, seed, key, purpose).limit(n)


def upsample(df: DataFrame, times: int = UPSAMPLE) -> DataFrame:
    """Every row times over, with repeat from 0."""
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def novel_names(rows: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Chat rows whose requests and targets use other names; names that renames lacks stay. The text is unchanged."""
    table = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    renamed = lambda n: F.coalesce(F.try_element_at(table, n), n)
    user, target = F.get("messages", F.lit(1))["content"], F.get("messages", F.lit(2))["content"]
    a = rows.withColumn("_names", X.request_names(user)).withColumn("_text", X.request_text(user))
    a = a.withColumn("_p", S.parse(target, F.col("_names")))
    spans = F.transform("_p.spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), renamed(s["label"]).alias("label")))
    a = a.withColumn("_tagged", S.inject("_text", spans)["tagged"])
    return a.withColumn("messages", X.chat(X.render_request(F.transform("_names", renamed), F.col("_text")), F.col("_tagged"))).drop("_names", "_text", "_p", "_tagged")


def anchor_mix(parts: dict[str, tuple[DataFrame, int]], seed: int) -> DataFrame:
    """Union of capped samples: name -> (rows with row_id, cap), in seeded order within each part."""
    out = None
    for name, (df, cap) in parts.items():
        one = seeded_cap(df, seed, cap).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def consistent_traces(rows: DataFrame, per_style: int, seed: int) -> DataFrame:
    """Traces (row_id, style, commitment, answer) whose committed line equals the answer, at most per_style of each style."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("style").orderBy(draw(seed, F.col("row_id"), "trace"), "row_id")
    return rows.where("commitment = answer").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_style).drop("_n")
