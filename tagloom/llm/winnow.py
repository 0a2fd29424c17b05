"""Operator 8: document fingerprints by winnowing, in DataFrame expressions only.

Units are the code points of a text but for ASCII white space. The rolling hash of each k-gram of units is a shift-and-xor
polynomial of their 64-bit hashes, built for all positions at once by doubling: h(i, 2m) = h(i, m) << m xor h(i + m, m).
Each window of w consecutive k-gram hashes selects its smallest, the rightmost of equal ones; every value carries its
position, so the pair (hash, position) is one long and a window minimum is a plain minimum. Any passage of
k + w - 1 units that two texts share, at whatever offset, gives them a common fingerprint hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACES = " \t\n\x0b\x0c\r"
K, W = 8, 8
#: Positions fit in 31 bits; a value is hash * 2^31 + (2^31 - 1 - position), the hash being the upper 32 bits of a k-gram's but one.
PLACE = 1 << 31
MAX_CUTS = 65_536


def _pairwise(left: str, skip: int, join) -> Column:
    """join(x[i], x[i + skip]) for every i that has both."""
    n = F.greatest(F.size(left) - skip, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(left, skip + 1, n), join)


def _rolled(span: int):
    return lambda a, b: F.shiftleft(a, span).bitwiseXOR(b)


def add_fingerprint(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Adds out: array of the selected values hash * 2^31 + (2^31 - 1 - position), in order of position.

    A text with fewer than k units has one k-gram, of all its units; fewer than w k-grams are one
    window; a null text or one without units has an empty array. k and w are powers of two.
    """
    if k & (k - 1) or w & (w - 1):
        raise ValueError("k and w are powers of two")
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_u", F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, ""))
    df = df.withColumn("_g", F.when(F.col("_u") != "", F.transform(F.split("_u", ""), lambda u: F.xxhash64(u))).otherwise(none)).drop("_u")
    # short texts are padded to one k-gram with zeros, which no other k-gram can be told from only by chance
    df = df.withColumn("_g", F.when((F.size("_g") > 0) & (F.size("_g") < k), F.slice(F.concat("_g", F.array_repeat(F.lit(0).cast("bigint"), k - 1)), 1, k)).otherwise(F.col("_g")))
    span = 1
    while 2 * span < k:
        df = df.withColumn("_g", _pairwise("_g", span, _rolled(span)))
        span *= 2
    # the last doubling and the packing with the position in one pass
    packed = lambda h, i: F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(-PLACE)).bitwiseOR(F.lit(PLACE - 1) - i)
    if k > 1:
        last = F.slice("_g", 1, F.greatest(F.size("_g") - span, F.lit(0)))
        df = df.withColumn("_v", F.transform(last, lambda h, i: packed(_rolled(span)(h, F.get("_g", i + span)), i)))
    else:
        df = df.withColumn("_v", F.transform("_g", packed))
    span = 1
    df = df.withColumn("_m", F.when(F.size("_v") >= w, F.col("_v")).otherwise(none))
    while span < w:
        df = df.withColumn("_m", _pairwise("_m", span, lambda a, b: F.least(a, b)))
        span *= 2
    whole = F.when(F.size("_v") > 0, F.array(F.array_min("_v"))).otherwise(none)
    return df.withColumn(out, F.when(F.size("_m") > 0, F.array_distinct("_m")).otherwise(whole)).drop("_g", "_v", "_m")


def hashes(values: str) -> Column:
    """Distinct hashes of an array of selected values."""
    return F.array_distinct(F.transform(values, lambda v: F.shiftright(v, 31)))


def positions(values: str) -> Column:
    """Unit position of each selected value."""
    return F.transform(values, lambda v: (F.lit(PLACE - 1) - F.pmod(v, F.lit(PLACE))).cast("int"))


def as_string(values: str) -> Column:
    """The selected values, hash and position, in order of position, hexadecimal, joined by spaces."""
    return F.array_join(F.transform(values, lambda v: F.hex(v)), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.greatest(union, F.lit(1))).cast("double")


def within(values: str, units: Column, k: int = K, w: int = W) -> Column:
    """The selected values of windows that lie within the first units of a text, from all of its values in order of position.

    A value's first window ends with it where it beats the value before it, the rightmost of equal ones winning; else it starts
    just after that value. So the windows of a text need not be gone through again. A text of fewer than k + w - 1 units has none.
    """
    place = lambda v: F.lit(PLACE - 1) - v.bitwiseAND(F.lit(PLACE - 1))
    last = units - (k + w - 1)

    def starts(v, i):
        before = F.get(values, i - 1)
        return F.when(i == 0, F.lit(0)).when(v < before, place(v) - (w - 1)).otherwise(place(before) + 1)

    return F.when(last >= 0, F.filter(values, lambda v, i: starts(v, i) <= last)).otherwise(F.array().cast("array<bigint>"))


def fingerprint(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, fingerprint (array<bigint> of hashes) and positions (array<int>) of every whole text.

    Null and empty texts have empty arrays; equal texts have equal fingerprints; repeated rows and
    null ids give one row each; other columns are ignored; an empty table gives an empty result.
    """
    rows = add_fingerprint(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), "_text", "_f", k, w)
    return rows.select(F.col("_id").alias(id_col), F.transform("_f", lambda v: F.shiftright(v, 31)).alias("fingerprint"), positions("_f").alias("positions"))


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = 1024, enrich: Callable[[DataFrame], DataFrame] | None = None, following: dict[str, str] | None = None) -> DataFrame:
    """_id, _text and _next, the text of the row after it in ascending order of id; the first row follows the last.

    enrich adds columns to the rows once they are dealt, and following names those of them to take from the next row too.

    Ids are cut into ranges at quantiles, at most MAX_CUTS, and ordered within each range, so no task sees all
    rows. The first row of each range is copied to the range before it. Null ids come first;
    equal ids are in order of their texts. Needs two passes over the id column and one exchange of texts.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    ids = rows.select(F.coalesce("_id", F.lit(-(1 << 63))).alias("_k"))
    n = ids.count()
    cuts = min(MAX_CUTS, math.ceil(n / rows_per_range))
    enrich, following = enrich or (lambda df: df), following or {}
    if n == 0:
        rows = enrich(rows)
        return rows.withColumn("_next", F.lit("")).withColumns({to: F.col(c) for c, to in following.items()})
    low = ids.agg(F.percentile_approx("_k", [i / cuts for i in range(cuts)], 10 * min(cuts, 10_000)).alias("q")).first()["q"]
    low = sorted(set(low))
    # binary search among the cuts, a bounded array: the number of cuts at or below the id
    steps = F.sequence(F.lit(1), F.lit(len(low).bit_length()))
    bounds = F.lit(low)
    key = F.coalesce("_id", F.lit(-(1 << 63)))

    def narrow(s, _):
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(F.col("_bounds"), mid) <= F.col("_k")
        return F.struct(F.when(s["lo"] >= s["hi"], s["lo"]).when(below, mid + 1).otherwise(s["lo"]).cast("int").alias("lo"), F.when(s["lo"] >= s["hi"], s["hi"]).when(below, s["hi"]).otherwise(mid).cast("int").alias("hi"))

    def ranged(df: DataFrame) -> DataFrame:
        found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(low)).alias("hi")), narrow, lambda s: s["lo"])
        return df.withColumn("_k", key).withColumn("_bounds", bounds).withColumn("_range", found).drop("_bounds")

    # at most MAX_CUTS + 1 ranges, one row each
    firsts = sorted((r["_range"], r["k"]) for r in ranged(rows.select("_id")).groupBy("_range").agg(F.min("_k").alias("k")).collect())
    first, before = [0] * (len(low) + 1), [0] * (len(low) + 1)
    for i, (r, k) in enumerate(firsts):
        first[r], before[r] = k, firsts[i - 1][0]
    here = F.struct(F.col("_range").alias("r"), F.lit(False).alias("copy"))
    earlier = F.struct(F.get(F.lit(before), F.col("_range")).cast("int").alias("r"), F.lit(True).alias("copy"))
    copied = ranged(rows).withColumn("_to", F.when(F.col("_k") == F.get(F.lit(first), F.col("_range")), F.array(here, earlier)).otherwise(F.array(here)))
    spread = copied.select("_id", "_text", "_k", F.explode("_to").alias("_to")).select("_id", "_k", "_text", "_to.r", "_to.copy")
    dealt = enrich(spread.repartition("r"))
    after = Window.partitionBy("r").orderBy("copy", "_k", F.xxhash64("_text"), "_text")
    dealt = dealt.withColumns({to: F.lead(c).over(after) for c, to in {"_text": "_next", **following}.items()})
    return dealt.where(~F.col("copy")).withColumn("_next", F.coalesce("_next", F.lit(""))).drop("_k", "r", "copy")


def fingerprint_with_edits(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next document. Its values come from those of the two documents and from the windows over the seam. Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint (strings of hexadecimal values),
    near_edited, near_next. Null texts count as empty; a table of one row follows itself.
    """
    # every text is fingerprinted once; the next document's values come with its text
    rows = with_next(docs, id_col, text_col, enrich=lambda df: add_fingerprint(df, "_text", "_f", k, w), following={"_f": "_xf"})
    rows = rows.withColumn("n_chars", F.length("_text").cast("long")).withColumn("_half", F.expr("cast(length(_text) div 2 as int)"))
    rows = rows.withColumn("_head", F.expr("substring(_text, 1, length(_text) - _half)")).withColumn("_tail", F.expr("substring(_next, 1, _half)"))
    # the edited text's windows are the head's, the tail's, and those over the seam, which see k + w - 2 units on either side at most
    side = k + w - 2
    rows = rows.withColumn("_hu", F.translate("_head", SPACES, "")).withColumn("_tu", F.translate("_tail", SPACES, ""))
    rows = rows.withColumn("_hn", F.length("_hu")).withColumn("_tn", F.length("_tu"))
    over = F.concat(F.right("_hu", F.lit(side)), F.left("_tu", F.lit(side)))
    short = (F.col("_hn") + F.col("_tn")) <= side
    rows = rows.withColumn("_seam", F.when(short, F.concat("_hu", "_tu")).when((F.col("_hn") > 0) & (F.col("_tn") > 0), over).otherwise(F.lit("")))
    rows = rows.withColumn("_at", F.when(short, F.lit(0)).otherwise(F.greatest(F.col("_hn") - side, F.lit(0))))
    rows = add_fingerprint(rows.drop("_hu", "_tu"), "_seam", "_s", k, w)
    later = lambda values, by: F.transform(values, lambda v: v - F.col(by))
    edited = F.concat(within("_f", F.col("_hn"), k, w), later("_s", "_at"), later(within("_xf", F.col("_tn"), k, w), "_hn"))
    rows = rows.withColumn("_e", F.array_distinct(edited)).withColumn("_fh", hashes("_f")).withColumn("_eh", hashes("_e")).withColumn("_xh", hashes("_xf"))
    return rows.select(
        F.col("_id").alias(id_col), "n_chars", F.sha2(F.concat("_head", "_tail").cast("binary"), 256).alias("edited_sha256"), as_string("_f").alias("fingerprint"),
        as_string("_e").alias("edited_fingerprint"), likeness("_fh", "_eh").alias("near_edited"), likeness("_fh", "_xh").alias("near_next"),
    )
