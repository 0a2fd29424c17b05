"""Operator 7: mixing sources to target weights by Poisson replication.

Source s of n_s rows has target weight w_s and mean repetition rate w_s * total / n_s. Each document
draws its number of copies by inverting the Poisson distribution with that mean at a uniform number that a
hash of seed and id gives, is exploded by that number, and all copies are shuffled globally by
a second hash. A large rate is a sum of draws at equal parts of it. No row depends on another one, so a lost task is redrawn alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SEED = "mix-1"
MOST_BROADCAST = 20_000
#: The largest rate of one draw; far below about 745, where the probability of no copy underflows.
MOST_RATE = 64.0


def uniform(*parts: Column) -> Column:
    """Uniform number in [0, 1) from the md5 of the parts; the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str, temperature: float, other_weight: float) -> DataFrame:
    """_source, _n, _rate: rows and mean repetition rate of every source, from one aggregation; nothing is collected.

    Without weights a source weighs n_s ** temperature; with weights a source that they do not name weighs other_weight.
    Weights are made to sum to one over the sources that occur. If all weigh nothing, all rates are 0.
    """
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        share = F.pow(F.col("_n").cast("double"), F.lit(float(temperature)))
    else:
        named = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, float(w))]) if weights else F.lit(None).cast("map<string,double>")
        share = F.coalesce(F.try_element_at(named, F.col("_source")), F.lit(float(other_weight)))
    sizes = cut(sizes.withColumn("_share", share))
    whole = sizes.agg(F.sum("_share").alias("_whole"), F.sum("_n").alias("_total")).withColumn("_one", F.lit(1))  # a single row
    rate = F.when(F.col("_whole") > 0, F.col("_share") / F.col("_whole") * F.col("_total") / F.col("_n")).otherwise(F.lit(0.0))
    return sizes.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one").select("_source", "_n", rate.alias("_rate"))


def poisson_cdf(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... as far as a uniform number of 48 bits can tell them from one; rate at most MOST_RATE."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / k)).alias("c"))
    most = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["c"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, other_weight: float = 0.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Replicated and globally shuffled docs, with all their columns, copy (from 0) and shuffle_key.

    The draw depends on seed and id only; rows that repeat an id draw alike, null ids as the text "null". A
    null source is a source of its own. weights are target shares by source, other_weight that of each source they do not
    name; without weights sources weigh their number of rows to the power temperature. Columns of docs called copy or shuffle_key are replaced. An empty
    table gives an empty result. Rows come out ordered by shuffle_key across partitions.
    """
    docs = docs.drop("copy", "shuffle_key")
    rates = source_rates(docs, weights, source_col, temperature, other_weight).withColumn("_parts", F.greatest(F.ceil(F.col("_rate") / F.lit(MOST_RATE)), F.lit(1)).cast("int"))
    table = cut(rates.select("_source", "_parts", poisson_cdf(F.col("_rate") / F.col("_parts")).alias("_cdf")))
    if table.count() <= MOST_BROADCAST:  # each row has at most about 200 numbers; beyond this the join is Spark's choice
        table = F.broadcast(table)
    columns = docs.columns
    docs = docs.join(table, F.col(source_col).cast("string").eqNullSafe(F.col("_source")), "left")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    draw = lambda u: F.size(F.filter("_cdf", lambda c: c <= u))
    more = lambda k: draw(uniform(F.lit(seed), F.lit("copies"), name, k.cast("string")))
    copies = draw(uniform(F.lit(seed), F.lit("copies"), name))
    copies = F.when(F.col("_parts") > 1, copies + F.aggregate(F.sequence(F.lit(1), F.col("_parts") - 1), F.lit(0), lambda n, k: n + more(k))).otherwise(copies)
    drawn = docs.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)))).select(*columns, "copy")
    key = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), name, F.col("copy").cast("string")).cast("binary")), 1, 16)
    return drawn.withColumn("shuffle_key", key).orderBy("shuffle_key", id_col, "copy")
