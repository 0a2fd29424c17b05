"""Operator 5: quality rules with robust multivariate outliers, in DataFrame expressions only.

Base statistics come from array expressions over each text, without a shuffle. A statistic vector of four transformed
rates is then held against a minimum-covariance-determinant estimate of its language and source:

1. Three starts per group: medians with absolute deviations alone, and with the correlations of the squashed and of the
   spatial-sign scores.
2. Each concentration step keeps the half of the group (parameter coverage) with the smallest Mahalanobis distances and
   estimates mean and covariance from it, until no determinant changes by 2 %, or six times (parameter steps). The start with the least determinant wins.
3. The covariance is made consistent for normal rows, and estimated once more from all rows within the 97.5 % ellipsoid.
4. Rows whose squared distance exceeds the chi-square quantile of the parameter tail are rejected.

The mean and covariance of a group of n rows are averaged with those of all rows together, with weights n and prior_rows, at
every size alike, so a small group leans on the whole and a large one on itself. Most documents have no symbols and no repeats, so half of a group
often has a singular covariance; the squared RESOLUTION of each statistic is added to its variance, as measuring errors are.

Groups only ever exist as partial sums and as counts by bucket, which combine in any order, so a hot
source is never gathered; the table of estimates has three rows per language and source.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, cut, native_words

#: Differences of the transformed statistics that mean nothing: word length, symbols, repeated lines, repeated words.
RESOLUTION = (0.02, 0.05, 0.1, 0.1)
VECTOR = ("x0", "x1", "x2", "x3")
P = len(VECTOR)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MOST_BROADCAST = 50_000
ALL = "all"


def base_statistics(docs: DataFrame, text: Column, keep: list[Column], hash_bits: int = 62) -> DataFrame:
    """The columns keep, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every whole text.

    Windows of three words are grouped by hash and equal hashes are then held against the words, so n_repeat_words is exact.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    a = docs.select(*keep, text.alias("_t"))
    b = a.select("*", native_words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    c = b.select(
        *[x for x in a.columns if x != "_t"],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "_w",
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    # Each 3-word window becomes one long: the upper part of its hash, then its position in as few bits as the
    # text needs. After sorting, equal windows are neighbours.
    d = c.withColumn("_unit", F.expr("shiftleft(1L, cast(ceil(log2(greatest(n_words, 2))) as int))"))
    d = d.withColumn("_room", F.expr(f"shiftleft(1L, greatest({hash_bits} - cast(ceil(log2(greatest(n_words, 2))) as int), 1))"))
    packed = F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2)), F.col("_room")) * F.col("_unit") + i)
    e = d.withColumn("_s", F.sort_array(packed)).drop("_h", "_room")
    place = lambda x: F.pmod(x, F.col("_unit")).cast("int")
    # y comes after x in the order, so they share the upper part if x is not below the first value with y's
    alike = lambda x, y: F.coalesce(x >= y - F.pmod(y, F.col("_unit")), F.lit(False))
    words_differ = lambda p, q: reduce(lambda o, k: o | (F.get("_w", p + k) != F.get("_w", q + k)), range(1, 3), F.get("_w", p) != F.get("_w", q))
    f = e.withColumn("_eq", F.when(F.size("_s") > 1, F.zip_with("_s", _next("_s"), alike)).otherwise(F.array().cast("array<boolean>"))).withColumn("_any", F.exists("_eq", lambda x: x))
    clash = F.exists(F.zip_with("_s", _next("_s"), lambda x, y: F.when(alike(x, y), words_differ(place(x), place(y))).otherwise(F.lit(False))), lambda x: x)
    f = f.withColumn("_clash", F.when(F.col("_any"), clash).otherwise(F.lit(False)))
    # where different windows share a hash, the windows themselves are sorted
    whole = F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - 3, F.lit(0))), lambda i: F.struct(F.get("_w", i).alias("a"), F.get("_w", i + 1).alias("b"), F.get("_w", i + 2).alias("c"), i.alias("i"))))
    f = f.withColumn("_whole", F.when(F.col("_clash"), whole))
    same = F.zip_with("_whole", _next("_whole"), lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False)))
    f = f.withColumn("_eq2", F.when(F.col("_clash"), same))
    at = F.when(F.col("_clash"), _with_equal("_whole", "_eq2", lambda x: x["i"])).when(F.col("_any"), _with_equal("_s", "_eq", place)).otherwise(F.array().cast("array<int>"))
    g = f.withColumn("_at", at).drop("_eq", "_s", "_any", "_unit", "_w", "_clash", "_whole", "_eq2")
    covered = F.size(F.array_distinct(F.flatten(F.transform("_at", lambda p: F.array(p, p + 1, p + 2)))))
    return g.withColumn("n_repeat_words", F.when(F.size("_at") > 0, covered).otherwise(F.lit(0)).cast("long")).drop("_at")


def _next(name: str) -> Column:
    """The array from its second element on."""
    return F.slice(name, 2, F.greatest(F.size(name) - 1, F.lit(1)))


def _with_equal(items: str, equal: str, place) -> Column:
    """Places of the sorted items that equal a neighbour; equal tells for each item whether the next one does."""
    marked = F.transform(items, lambda x, i: F.when(F.get(equal, i) | ((i > 0) & F.get(equal, F.greatest(i - 1, F.lit(0)))), place(x)))
    return F.filter(marked, lambda p: p.isNotNull())


def _vector() -> list[Column]:
    """Transformed rates: word length, symbols, repeated lines, repeated words; each steadied for short texts."""
    n = F.col("n_words").cast("double")
    return [
        F.log((F.col("word_chars") + F.lit(500.0)) / (n + F.lit(100.0))),
        F.log1p(F.lit(20.0) * F.col("n_symbols") / (F.col("word_chars") + F.lit(50.0))),
        F.log1p(F.col("n_dup_lines").cast("double")) / F.lit(4.0),
        F.lit(2.0) * F.col("n_repeat_words") / (n + F.lit(10.0)),
    ]


def chi2_tail(x: float, p: int) -> float:
    """Probability that a chi-square variable with an even number p of degrees exceeds x."""
    return math.exp(-x / 2) * math.fsum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(tail: float, p: int = P) -> float:
    """The value that is exceeded with probability tail."""
    low, high = 0.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, p) > tail else (low, mid)
    return low


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal rows is multiplied with to be that of all."""
    return share / (1 - chi2_tail(chi2_quantile(1 - share), P + 2))


def _quantile(rows: DataFrame, keys: list[str], bucket: Column, share: float) -> DataFrame:
    """keys, bucket: per key the first bucket up to which at least share of the rows lie.

    Rows are counted by bucket before the shuffle; a key has as many rows as it has buckets, whatever its size.
    """
    counted = rows.groupBy(*keys, bucket.cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("_n"))
    to, whole = F.sum("_n").over(Window.partitionBy(*keys).orderBy("bucket")), F.sum("_n").over(Window.partitionBy(*keys))
    return counted.select(*keys, "bucket", to.alias("_to"), whole.alias("_all")).where(F.col("_to") >= F.ceil(F.lit(share) * F.col("_all"))).groupBy(*keys).agg(F.min("bucket").alias("bucket"))


#: Buckets of a transformed statistic, and of a squared distance (about 1 % wide).
GRAIN = 1000.0


def _distance_bucket(d2: Column) -> Column:
    return F.floor(F.lit(100.0) * F.log1p(F.lit(100.0) * d2))


def _medians(members: DataFrame, values: list[str], names: str) -> DataFrame:
    """_g and four columns called names0..names3: medians of four values, to the nearest thousandth."""
    long = members.selectExpr("_g", f"posexplode(array({', '.join(values)})) AS (_v, _x)")
    m = _quantile(long, ["_g", "_v"], F.floor(F.col("_x") * F.lit(GRAIN)), 0.5)
    return m.groupBy("_g").agg(*[F.expr(f"max(CASE WHEN _v = {i} THEN (bucket + 0.5D) / {GRAIN}D END) AS {names}{i}") for i in range(P)])


# The algebra of the small matrices is SQL text: later columns of a select refer to earlier ones.
def _factor() -> list[str]:
    """l{i}{j}, the lower Cholesky factor of the covariance columns c{i}{j}, and ld, the logarithm of its determinant."""
    out = []
    for i, j in PAIRS:
        rest = " - ".join([f"c{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]])
        out.append(f"sqrt(greatest({rest}, 1e-9D)) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return [*out, f"2 * ({' + '.join(f'ln(l{i}{i})' for i in range(P))}) AS ld"]


ESTIMATE = ["_g", "_s", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS], "ld"]


def _with_distance(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds _s and _d2; a row for each estimate of its group."""
    y = []
    for i in range(P):
        rest = " - ".join([f"({VECTOR[i]} - m{i})", *[f"l{i}{k} * _y{k}" for k in range(i)]])
        y.append(f"({rest}) / l{i}{i} AS _y{i}")
    out = rows.join(groups, ["_g"], "left").selectExpr(*rows.columns, "_s", *y, f"{' + '.join(f'_y{i} * _y{i}' for i in range(P))} AS _d2")
    return out.select(*rows.columns, "_s", "_d2")


def _starts(members: DataFrame, hint, prior_rows: float) -> DataFrame:
    """Three estimates per group around its medians."""
    med = hint(cut(_medians(members, list(VECTOR), "q")))
    dev = _medians(members.join(med, ["_g"]), [f"abs({x} - q{i})" for i, x in enumerate(VECTOR)], "a")
    table = hint(cut(med.join(dev, ["_g"]).selectExpr("_g", *[f"q{i}" for i in range(P)], *[f"sqrt(pow(1.4826D * a{i}, 2) + {RESOLUTION[i] ** 2!r}D) AS s{i}" for i in range(P)])))
    z = members.join(table, ["_g"]).selectExpr("_g", *[f"({x} - q{i}) / s{i} AS z{i}" for i, x in enumerate(VECTOR)], f"sqrt({' + '.join(f'z{i} * z{i}' for i in range(P))} + 1e-12D) AS _z")
    z = z.selectExpr("_g", *[f"tanh(z{i}) AS t{i}" for i in range(P)], *[f"z{i} / _z AS u{i}" for i in range(P)])
    sums = ["count(1) AS n", *[f"avg(t{i}) AS t{i}" for i in range(P)], *[f"avg({k}{i} * {k}{j}) AS {k}{i}{j}" for k in "tu" for i, j in PAIRS]]
    s = z.groupBy("_g").agg(*map(F.expr, sums)).join(table, ["_g"])

    def correlation(kind: str, i: int, j: int) -> str:
        part = lambda a, b: f"({kind}{a}{b} - t{a} * t{b})" if kind == "t" else f"{kind}{a}{b}"
        # few rows say little about correlation
        return f"n / (n + {prior_rows!r}D) * {part(i, j)} / sqrt(({part(i, i)} + 1e-3D) * ({part(j, j)} + 1e-3D))"

    def start(k: int, kind: str | None) -> str:
        cov = [f"s{i} * s{j} * {'1D' if i == j else correlation(kind, i, j) if kind else '0D'} AS c{i}{j}" for i, j in PAIRS]
        return f"struct({k} AS _s, {', '.join(cov)})"

    each = s.selectExpr("_g", *[f"q{i} AS m{i}" for i in range(P)], f"inline(array({start(0, None)}, {start(1, 't')}, {start(2, 'u')}))")
    return each.selectExpr("*", *_factor()).select(*ESTIMATE)


def _estimate(rows: DataFrame, share: float, prior_rows: float) -> DataFrame:
    """Mean and covariance of the rows of each _g and _s, consistent for the nearest share of a group, with prior_rows rows of the estimate of all rows."""
    sums = ["count(1) AS n", *[f"avg({x}) AS o{i}" for i, x in enumerate(VECTOR)], *[f"avg({VECTOR[i]} * {VECTOR[j]}) AS q{i}{j}" for i, j in PAIRS]]
    g = rows.groupBy("_g", "_s").agg(*map(F.expr, sums)).selectExpr("_g", "_s", "n", *[f"o{i}" for i in range(P)], *[f"{consistency(share)!r}D * (q{i}{j} - o{i} * o{j}) AS q{i}{j}" for i, j in PAIRS])
    whole = g.where(F.col("_g") == ALL).selectExpr("_s", *[f"{c} AS p_{c}" for c in g.columns if c not in ("_g", "_s", "n")])  # one row a start
    w = f"CASE WHEN _g = '{ALL}' THEN 1D ELSE n / (n + {float(prior_rows)!r}D) END AS w"
    cov = [f"w * q{i}{j} + (1 - w) * p_q{i}{j} + {RESOLUTION[i] ** 2 if i == j else 0.0!r}D AS c{i}{j}" for i, j in PAIRS]
    return g.join(F.broadcast(whole), ["_s"]).selectExpr("_g", "_s", w, *[f"w * o{i} + (1 - w) * p_o{i} AS m{i}" for i in range(P)], *cov, *_factor()).select(*ESTIMATE)


def mcd_estimates(members: DataFrame, coverage: float = 0.5, steps: int = 6, prior_rows: float = 30.0) -> DataFrame:
    """One estimate (ESTIMATE) per _g of members (_g, x0..x3), in which every row also occurs with _g = ALL.

    steps bounds the concentration steps; they end as soon as no determinant changes by 2 %.
    """
    n = members.select("_g").distinct().count()
    hint = F.broadcast if 3 * n <= MOST_BROADCAST else (lambda df: df)  # one check for all tables of one or three rows per group
    groups = cut(_starts(members, hint, prior_rows))
    for _ in range(steps):
        near = _with_distance(members, hint(groups))
        limit = _quantile(near, ["_g", "_s"], _distance_bucket(F.col("_d2")), coverage)
        inside = near.join(hint(limit), ["_g", "_s"]).where(_distance_bucket(F.col("_d2")) <= F.col("bucket"))
        now = cut(_estimate(inside, coverage, prior_rows))
        moved = now.select("_g", "_s", "ld").join(hint(groups.selectExpr("_g", "_s", "ld AS _old")), ["_g", "_s"]).agg(F.expr("max(abs(ld - _old))")).first()[0]
        groups = now
        if moved is None or moved <= 0.02:
            break
    best = groups.groupBy("_g").agg(F.expr(f"min_by(struct({', '.join(ESTIMATE[2:])}), struct(round(ld, 9), _s)) AS _e")).select("_g", F.lit(0).alias("_s"), "_e.*")
    # every row within the 97.5 % ellipsoid counts in the last estimate; only the better start of each group is left
    near = _with_distance(members, hint(best)).where(F.col("_d2") <= chi2_quantile(0.025))
    last = cut(_estimate(near, 0.975, prior_rows))
    # a group without a row there, such as one far row alone, has the estimate of all rows
    none = best.select("_g", "_s").join(last.select("_g"), ["_g"], "left_anti")
    return last.unionByName(none.join(F.broadcast(last.where(F.col("_g") == ALL).drop("_g")), ["_s"]))


def quality_verdicts(docs: DataFrame, tail: float = 1e-6, coverage: float = 0.5, steps: int = 6, prior_rows: float = 30.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Base statistics and verdict for every row of docs.

    Returns the columns carry, id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    distance2. base_failed: n_words < 50 or 100 n_repeat_words > 50 n_words. kept: not base_failed and
    squared Mahalanobis distance to the estimate of its language and source within the chi-square quantile of tail.
    Estimates use rows that pass the base rules only; null languages and sources are values of their own; a
    group of any size has its own estimate, to which all rows together add prior_rows rows. Null texts have no
    words and fail; rows in the bucket of the coverage quantile are all kept in a step; repeated rows count as often as
    they occur; an empty table gives an empty result. carry names further columns of docs to pass through; all
    other columns are ignored. distance2 is null where no row of the language and source passes the base rules.
    """
    keep = [F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]).alias("_row"), F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source")]
    stats = base_statistics(docs, F.col(text_col), keep)
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    # the key of all rows together is none that a language and source can have
    stats = cut(stats.select("*", *[x.alias(name) for x, name in zip(_vector(), VECTOR, strict=True)], F.to_json(F.struct("_lang", "_source"), {"ignoreNullFields": "false"}).alias("_g")).drop("_lang", "_source"))
    members = stats.where(~F.col("base_failed")).select(F.explode(F.array(F.col("_g"), F.lit(ALL))).alias("_g"), *VECTOR)
    groups = mcd_estimates(members, coverage, steps, prior_rows)
    hint = F.broadcast if groups.count() <= MOST_BROADCAST else (lambda df: df)
    out = _with_distance(stats, hint(groups))
    return out.select(
        *[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(carry)], F.col("_row.id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("_d2") <= chi2_quantile(tail), F.lit(True))).alias("kept"), F.col("_d2").alias("distance2"),
    )
