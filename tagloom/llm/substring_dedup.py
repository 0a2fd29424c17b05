"""Operator 1: exact substring deduplication behind a count-min prefilter.

1. Each bucket of documents hashes its 13-word windows, each once, and sends every hash shard its
   own sketch of the window counts: the cells that its windows touch, in two rows of counters.
2. A shard adds the sketches of all buckets up. Because a cell also counts other windows, the smaller of a
   window's two counters overestimates, never underestimates, the number of buckets with it. The shard
   answers each bucket with one bit a window: estimated in two buckets or more.
3. Only windows so estimated are sent on, as 96-bit hashes with the smallest doc_id of the bucket, and
   grouped exactly: the shard names those that start in a smaller doc_id elsewhere.
4. Each bucket removes the words covered by windows that a smaller doc_id has, in the bucket or elsewhere.

The sketch is as wide as the corpus needs but lies spread over the shards: nothing is broadcast or collected, and
buckets, shards and answers have the size that bucket_count sets. A bucket is read three times; Spark reuses its exchange.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, hash_bucket, table, text_volume, utf8
from .shards import BLOCK, B, block_count, cells, grams, pack, split_bounds, word_hashes

WINDOW = 13
_LAST = int(np.iinfo(np.int64).max)
_ASK = "shard int, bucket int, n binary, a binary, b binary"
_SEND = "shard int, bucket int, h binary, g binary, d binary"
_ANSWER = "bucket int, shard int, bits binary"
#: Characters of a word and the space after it, for the width of the sketch only.
WORD_CHARS = 6


class _Bucket:
    """Window hashes of the documents of one bucket."""

    def __init__(self, docs: pa.Table, window: int):
        ids = docs.column("doc_id").to_pylist()
        texts = utf8(docs.column("text"))
        self.order = sorted(range(len(ids)), key=lambda k: _LAST if ids[k] is None else ids[k])
        self.ids = np.array([_LAST if ids[k] is None else ids[k] for k in self.order], np.int64)
        self.texts = [texts[k] for k in self.order]
        first, second, self.n_words, start = [], [], [], [0]
        for t in self.texts:
            h = word_hashes((t or b"").split())
            self.n_words.append(len(h))
            g = grams(h, window)
            first.append(g)
            second.append((grams(h, window, B) >> np.uint64(32)).astype(np.uint32))
            start.append(start[-1] + len(g))
        self.start = np.array(start)
        h = np.concatenate(first) if first else np.zeros(0, np.uint64)
        g = np.concatenate(second) if second else np.zeros(0, np.uint32)
        doc = np.repeat(self.ids, np.diff(self.start)) if len(self.ids) else np.zeros(0, np.int64)
        # documents are in ascending order, so the first of equal windows has the smallest doc_id
        by_hash = np.argsort(h, kind="stable")
        hs = h[by_hash]
        one = np.append(True, hs[1:] != hs[:-1]) if len(hs) else np.zeros(0, bool)
        self.u, self.g, self.least = hs[one], g[by_hash][one], doc[by_hash][one]
        self.doc = doc
        self.number = np.empty(len(h), np.int64)  # of each window among the distinct ones
        self.number[by_hash] = np.cumsum(one) - 1


def _ask(docs: pa.Table, shards: int, blocks: int, window: int) -> pa.Table:
    b = _Bucket(docs, window)
    at = split_bounds(b.u, shards, blocks)
    bucket = docs.column("bucket")[0].as_py()
    full = [s for s in range(shards) if at[s + 1] > at[s]]
    packed = [pack(b.u[at[s] : at[s + 1]], s, shards, blocks) for s in full]
    return table(_ASK, shard=full, bucket=[bucket] * len(full), n=[x[0] for x in packed], a=[x[1] for x in packed], b=[x[2] for x in packed])


def _estimate(asked: pa.Table, shards: int, blocks: int) -> pa.Table:
    """Merge the sketches of a shard; one bit per window and bucket: both its counters are two or more."""
    rows = asked.num_rows
    n, sides = asked.column("n").to_pylist(), [asked.column(c).to_pylist() for c in ("a", "b")]
    merged = []
    for side in sides:
        counter = np.zeros(blocks // shards * BLOCK, np.uint8)
        for k in range(rows):
            touched = np.sort(cells(n[k], side[k]))
            again = touched[1:][touched[1:] == touched[:-1]]  # two windows of the bucket in one cell
            counter[touched] = np.minimum(counter[touched] + 1, 2)
            counter[again] = 2
        merged.append(counter)
    bits = [np.packbits(np.minimum(merged[0][cells(n[k], sides[0][k])], merged[1][cells(n[k], sides[1][k])]) >= 2).tobytes() for k in range(rows)]
    return table(_ANSWER, bucket=asked.column("bucket").combine_chunks(), shard=asked.column("shard").combine_chunks(), bits=bits)


def _answers(answer: pa.Table) -> dict[int, bytes]:
    return dict(zip(answer.column("shard").to_pylist(), answer.column("bits").to_pylist(), strict=True))


def _send(docs: pa.Table, answer: pa.Table, shards: int, blocks: int, window: int) -> pa.Table:
    if docs.num_rows == 0:
        return table(_SEND, shard=[], bucket=[], h=[], g=[], d=[])
    b = _Bucket(docs, window)
    at = split_bounds(b.u, shards, blocks)
    bucket = docs.column("bucket")[0].as_py()
    out: dict[str, list] = {"shard": [], "bucket": [], "h": [], "g": [], "d": []}
    for s, bits in _answers(answer).items():
        lo, hi = at[s], at[s + 1]
        keep = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(hi - lo)).astype(bool)
        if keep.any():
            out["shard"].append(s)
            out["bucket"].append(bucket)
            for name, values in (("h", b.u), ("g", b.g), ("d", b.least)):
                out[name].append(values[lo:hi][keep].tobytes())
    return table(_SEND, **out)


def _settle(sent: pa.Table) -> pa.Table:
    """Group the candidates of a shard exactly; to each bucket, the hashes of its windows that a smaller doc_id elsewhere has."""
    h, g, d = (np.concatenate([np.frombuffer(x, kind) for x in sent.column(c).to_pylist()]) for c, kind in (("h", np.uint64), ("g", np.uint32), ("d", np.int64)))
    rows = sent.num_rows
    size = [len(x) // 8 for x in sent.column("h").to_pylist()]
    row = np.repeat(np.arange(rows), size)
    order = np.lexsort((d, g, h))
    first = np.append(True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1]))
    least = d[order][first][np.cumsum(first) - 1]
    late = order[d[order] > least]
    late = late[np.argsort(row[late], kind="stable")]
    cut = np.searchsorted(row[late], np.arange(rows + 1))
    return table(_ANSWER, bucket=sent.column("bucket").combine_chunks(), shard=sent.column("shard").combine_chunks(), bits=[h[late[cut[k] : cut[k + 1]]].tobytes() for k in range(rows)])


def _remove(docs: pa.Table, answer: pa.Table, window: int, schema: str) -> pa.Table:
    if docs.num_rows == 0:
        return table(schema, doc_id=[], n_words=[], n_removed=[], kept_text=[], carry=[])
    b = _Bucket(docs, window)
    elsewhere = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in answer.column("bits").to_pylist())]))
    late = np.zeros(len(b.u), bool)
    late[np.searchsorted(b.u, elsewhere)] = True  # every one of them is a window of this bucket
    flag = (b.least[b.number] < b.doc) | late[b.number]
    removed, kept = [0] * len(b.texts), [b""] * len(b.texts)
    for k, text in enumerate(b.texts):
        words = (text or b"").split()
        at = np.flatnonzero(flag[b.start[k] : b.start[k + 1]])
        if len(at):
            edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + window, minlength=len(words) + 1)
            covered = np.cumsum(edge[:-1]) > 0
            removed[k] = int(covered.sum())
            words = list(compress(words, (~covered).tolist()))
        kept[k] = b" ".join(words)
    carry = docs.column("carry").to_pylist()
    ids = docs.column("doc_id").to_pylist()
    return table(schema, doc_id=[ids[k] for k in b.order], n_words=b.n_words, n_removed=removed, kept_text=pa.array(kept, pa.binary()).cast(pa.string()), carry=[carry[k] for k in b.order])


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes each word covered by a window of words that also starts in a document with a smaller id.

    Returns id_col, n_words, n_removed, kept_text (kept words joined by one space) and the columns carry of docs.
    Windows are judged on the input. Null and empty texts have no words and an empty kept_text; rows with
    equal ids do not remove from each other; a null id counts as larger than all others; other
    columns are ignored; an empty table gives an empty result. Needs one aggregation of text lengths first.
    """
    _, chars = text_volume(docs, text_col)
    buckets = bucket_count(chars)
    shards = buckets
    blocks = block_count(chars / WORD_CHARS, shards)
    carried = F.to_json(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])) if carry else F.lit(None).cast("string")
    dealt = docs.select(hash_bucket(buckets, id_col, text_col).alias("bucket"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), carried.alias("carry"))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, carry string"
    asked = dealt.groupBy("bucket").applyInArrow(lambda t: _ask(t, shards, blocks, window), _ASK)
    estimated = asked.groupBy("shard").applyInArrow(lambda t: _estimate(t, shards, blocks), _ANSWER)
    sent = dealt.groupBy("bucket").cogroup(estimated.groupBy("bucket")).applyInArrow(lambda d, a: _send(d, a, shards, blocks, window), _SEND)
    settled = sent.groupBy("shard").applyInArrow(_settle, _ANSWER)
    out = dealt.groupBy("bucket").cogroup(settled.groupBy("bucket")).applyInArrow(lambda d, a: _remove(d, a, window, schema), schema)
    kind = docs.schema[id_col].dataType
    out = out.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnRenamed("doc_id", id_col)
    if not carry:
        return out.drop("carry")
    inner = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    parsed = out.withColumn("_c", F.from_json("carry", inner))
    return parsed.select(id_col, "n_words", "n_removed", "kept_text", *[F.col(f"_c.c{k}").alias(c) for k, c in enumerate(carry)])
