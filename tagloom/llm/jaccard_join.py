"""Operator 10: exact Jaccard join of n-gram sets as a metric-space join.

Jaccard distance is a metric, so pivots and the triangle inequality bound distances never computed. On
shingle sets nearly all distances are 1, and pivots drawn from the whole corpus would put
every document into every region. The join therefore starts from regions that no link leaves:

1. Documents are dealt into buckets; equal sets of a bucket collapse. Hash shards tell each bucket,
   by a sketch that never underestimates, in how many sets each of its shingles occurs. A document with fewer than
   the threshold's share of shingles in two sets or more has no partner and is done.
2. The rest are ordered by rarity, and the shingles among which two linked documents must
   share one are their cells. Regions are the connected parts of documents and cells.
3. Each region is joined exactly and recursively. Pivots create Voronoi regions; a document also goes to every region
   whose pivot is at most twice the distance threshold further than its nearest, and no link can then be
   missed. Where the windows hold everything, pivots are settled one by one in a small region; in a larger one members are
   ordered by their distance to a pivot and compared in tiles, as bits. In both the
   triangle inequality skips pairs whose distances to a settled pivot differ by more than the threshold.
4. A region whose sets exceed max_region_bytes or max_region_sets, such as a hot group of near copies, is not gathered: pivots are
   measured against salted parts of it and deal it into Voronoi regions with windows, which go on recursively; a
   region whose members are known to be one component is done. Where the windows hold nearly everything, each two salted
   blocks of the region meet in a task of their own, so one round ends it.

Only connectivity is kept, never all pairs of a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, cut, cut_round, hash_bucket, table, text_volume, utf8
from .graph import components
from .shards import BLOCK, block_count, cells, grams, mix64, pack, split_bounds, word_hashes

_ASK = "shard int, bucket int, n binary, a binary, c binary"
_ANSWER = "bucket int, shard int, counts binary"
_SETS = "doc_id bigint, n bigint, cls binary, grams binary, cells array<bigint>"
WORD_CHARS = 6


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Ascending distinct shingle hashes; A-Z lowered, ASCII white space splits; all words if fewer than n."""
    words = (text or b"").lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    if len(h) < n:
        # shorter sequences are told from longer ones by their length
        return mix64(grams(h, len(h)) + np.uint64(len(h)))
    return np.unique(grams(h, n))


class _Bucket:
    """Distinct shingle sets of one bucket."""

    def __init__(self, docs: pa.Table, n: int):
        self.sets: list[np.ndarray] = []
        self.digest: list[bytes] = []
        self.size: list[int] = []
        self.of: list[int] = []  # per document: number of its set, or -1 if it has no words
        seen: dict[bytes, int] = {}
        for t in utf8(docs.column("text")):
            s = shingle_set(t, n)
            self.size.append(len(s))
            if not len(s):
                self.of.append(-1)
                continue
            key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            if key not in seen:
                seen[key] = len(self.sets)
                self.sets.append(s)
                self.digest.append(key)
            self.of.append(seen[key])
        every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        self.u, self.count = np.unique(every, return_counts=True)


def _ask(docs: pa.Table, shards: int, blocks: int, n: int) -> pa.Table:
    b = _Bucket(docs, n)
    at = split_bounds(b.u, shards, blocks)
    bucket = docs.column("bucket")[0].as_py()
    full = [s for s in range(shards) if at[s + 1] > at[s]]
    packed = [pack(b.u[at[s] : at[s + 1]], s, shards, blocks)[:2] for s in full]
    count = np.minimum(b.count, 255).astype(np.uint8)
    return table(_ASK, shard=full, bucket=[bucket] * len(full), n=[x for x, _ in packed], a=[x for _, x in packed], c=[count[at[s] : at[s + 1]].tobytes() for s in full])


def _answer(asked: pa.Table, shards: int, blocks: int) -> pa.Table:
    """In how many sets each shingle occurs, never too few, up to 255."""
    where = [cells(n, a) for n, a in zip(asked.column("n").to_pylist(), asked.column("a").to_pylist(), strict=True)]
    total = np.zeros(blocks // shards * BLOCK, np.uint32)
    for at, c in zip(where, asked.column("c").to_pylist(), strict=True):
        np.add.at(total, at, np.frombuffer(c, np.uint8))
    total = np.minimum(total, 255).astype(np.uint8)
    return table(_ANSWER, bucket=asked.column("bucket").combine_chunks(), shard=asked.column("shard").combine_chunks(), counts=[total[at].tobytes() for at in where])


def _sets(docs: pa.Table, answer: pa.Table, shards: int, blocks: int, n: int, percent: int) -> pa.Table:
    """Size and set digest of every document; the first document of a set that may have partners carries shingles and cells."""
    if docs.num_rows == 0:
        return table(_SETS, doc_id=[], n=[], cls=[], grams=[], cells=[])
    b = _Bucket(docs, n)
    at = split_bounds(b.u, shards, blocks)
    often = np.ones(len(b.u), np.uint8)
    for s, c in zip(answer.column("shard").to_pylist(), answer.column("counts").to_pylist(), strict=True):
        often[at[s] : at[s + 1]] = np.frombuffer(c, np.uint8)
    shingles: list[bytes | None] = [None] * len(b.sets)
    chosen: list[np.ndarray | None] = [None] * len(b.sets)
    for k, s in enumerate(b.sets):
        df = often[np.searchsorted(b.u, s)]
        need = -(-percent * len(s) // 100)  # a partner shares at least so many
        shared = int((df >= 2).sum())
        if shared < need:
            continue
        # rarest first, ties by hash: one order for all documents. Two partners share one of the first len - need + 1
        order = np.lexsort((s, df))[: len(s) - need + 1]
        order = order[df[order] >= 2]
        shingles[k], chosen[k] = s.tobytes(), s[order].view(np.int64)
    given: set[int] = set()
    g, c = [], []
    for k in b.of:
        first = k >= 0 and k not in given
        given.add(k)
        g.append(shingles[k] if first else None)
        c.append(chosen[k] if first else None)
    return table(_SETS, doc_id=docs.column("doc_id").combine_chunks(), n=b.size, cls=[b.digest[k] if k >= 0 else None for k in b.of], grams=g, cells=c)


def _overlaps(flat: np.ndarray, start: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Size of the intersection of s with each set in flat."""
    hit = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)


class Region:
    """Sets of one region; joins them exactly and keeps components only."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets], np.int64)
        self.parent = list(range(len(sets)))
        self.measured = 0

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def distances(self, p: int, members: np.ndarray) -> np.ndarray:
        """Jaccard distances from p; links found on the way join components."""
        flat = np.concatenate([self.sets[m] for m in members])
        start = np.concatenate(([0], np.cumsum(self.size[members])[:-1]))
        both = _overlaps(flat, start, self.sets[p])
        union = self.size[members] + self.size[p] - both
        self.measured += len(members)
        for m in members[100 * both >= self.percent * union].tolist():
            a, b = self.find(p), self.find(m)
            self.parent[max(a, b)] = min(a, b)
        return 1.0 - both / union

    def join(self, members: np.ndarray, least: int = 48, pivots: int = 6) -> None:
        """Find every link among members that connects two components."""
        eps = 1.0 - self.percent / 100 + 1e-9
        todo = [members]
        while todo:
            region = todo.pop()
            if len(region) < 2 or len({self.find(m) for m in region.tolist()}) == 1:
                continue
            if len(region) > least:
                chosen = region[:: max(1, len(region) // pivots)][:pivots]
                d = np.stack([self.distances(int(p), region) for p in chosen])
                near = d.min(0)
                parts = [region[d[j] - near <= 2 * eps] for j in range(len(chosen))]  # home, or within the window
                if sum(len(x) ** 2 for x in parts) <= 0.5 * len(region) ** 2:  # fewer pairs, and each part at most 0.71 of the region
                    todo += parts
                else:
                    self.cross(region, region, eps)
                continue
            self._settle(region, eps)

    def _settle(self, region: np.ndarray, eps: float) -> None:
        """Pivots leave one by one, each measured against the members that its triangles allow."""
        seen: list[np.ndarray] = []  # distances of settled pivots to the members, nan where not measured
        for i in range(len(region) - 1):
            roots = np.array([self.find(m) for m in region[i:].tolist()])
            rest = np.flatnonzero(roots[1:] != roots[0]) + i + 1  # the same component needs no further link
            if not len(rest) and (roots == roots[0]).all():
                return
            for d in seen:
                rest = rest[~(np.abs(d[rest] - d[i]) > eps)]
            if len(rest):
                d = np.full(len(region), np.nan)
                d[rest] = self.distances(int(region[i]), region[rest])
                seen = [*seen[-3:], d]

    def _bits(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles that more than a 32nd of members have, as words of 64 bits by word and member; and each member's number of other shared ones."""
        n = len(members)
        of = np.repeat(np.arange(n), self.size[members])
        _, which, count = np.unique(np.concatenate([self.sets[m] for m in members]), return_inverse=True, return_counts=True)
        many = count > max(1, n // 32)
        rest = np.bincount(of[((count > 1) & ~many)[which]], minlength=n)
        hit = many[which]
        column = (np.cumsum(many) - 1)[which[hit]]
        words = -(-int(many.sum()) // 64)
        bits = np.zeros(words * n, np.uint64)
        np.bitwise_or.at(bits, (column >> 6) * n + of[hit], np.uint64(1) << (column & 63).astype(np.uint64))
        return bits.reshape(words, n), rest

    def cross(self, rows: np.ndarray, cols: np.ndarray, eps: float) -> None:
        """Find every link of rows with cols that connects two components; rows may be cols, and then each pair is met once.

        Both are ordered by their distance to a pivot, and a tile of rows meets the columns that triangles allow. The bits give
        an intersection's size but for shingles that few members have: enough without them is a link, too few with all of them none,
        and only pairs between are measured.
        """
        alike = rows is cols
        members = rows if alike else np.concatenate((rows, cols))
        d = self.distances(int(members[0]), members)
        _, label = np.unique([self.find(m) for m in members.tolist()], return_inverse=True)
        if not label.any():
            return
        bits, rest = self._bits(members)
        size = self.size[members]
        a_all, b_all = np.arange(len(rows)), np.arange(0 if alike else len(rows), len(members))
        a_all, b_all = (x[np.argsort(d[x], kind="stable")] for x in (a_all, b_all))
        tile = max(1, min(256, 2_000_000 // len(b_all)))
        for at in range(0, len(a_all), tile):
            a = a_all[at : at + tile]
            low, high = np.searchsorted(d[b_all], d[a[0]] - eps), np.searchsorted(d[b_all], d[a[-1]] + eps, "right")
            b = b_all[max(low, at) if alike else low : high]
            both = np.zeros((len(a), len(b)), np.int32)
            for word in bits:
                both += np.bitwise_count(word[a][:, None] & word[b])
            need = -(-self.percent * (size[a][:, None] + size[b]) // (100 + self.percent))
            may = (both + np.minimum(rest[a][:, None], rest[b]) >= need) & (label[a][:, None] != label[b])
            for k in np.flatnonzero(may.any(1)).tolist():
                for sure in (True, False):
                    to = b[may[k] & ((both[k] >= need[k]) == sure)]
                    to = to[label[to] != label[a[k]]]
                    if len(to) and not sure:
                        to = to[self.distances(int(members[a[k]]), members[to]) <= eps]
                    if len(to):
                        joined = np.zeros(len(members), bool)
                        joined[label[to]] = True
                        label[joined[label]] = label[a[k]]
        first: dict[int, int] = {}
        for m, at in zip(members.tolist(), label.tolist(), strict=True):
            x, y = self.find(first.setdefault(at, m)), self.find(m)
            self.parent[max(x, y)] = min(x, y)


def _join_region(members: pa.Table, percent: int) -> pa.Table:
    """Each member and the smallest node of its component; the same whatever the order of the rows."""
    nodes = members.column("node").to_numpy()
    order = np.argsort(nodes, kind="stable")
    grams_of = members.column("grams").to_pylist()
    r = Region([np.frombuffer(grams_of[k], np.uint64) for k in order], percent)
    r.join(np.arange(len(nodes)))
    root = np.array([r.find(k) for k in range(len(nodes))])
    return table("a bigint, b bigint", a=nodes[order], b=nodes[order][root])


def _join_blocks(members: pa.Table, percent: int) -> pa.Table:
    """Edges between components of two blocks of a region (columns i, j, salt, node, component, grams) that a link of their members connects."""
    members = members.sort_by("node")
    nodes, salt = members.column("node").to_numpy(), members.column("salt").to_numpy()
    i, j = members.column("i")[0].as_py(), members.column("j")[0].as_py()
    r = Region([np.frombuffer(x, np.uint64) for x in members.column("grams").to_pylist()], percent)
    _, first, known = np.unique(members.column("component").to_numpy(), return_index=True, return_inverse=True)
    r.parent = first[known].tolist()
    rows = np.flatnonzero(salt == i)
    cols = rows if i == j else np.flatnonzero(salt == j)
    if len(rows) and len(cols):
        r.cross(rows, cols, 1.0 - percent / 100 + 1e-9)
    root = np.array([r.find(k) for k in first.tolist()])
    new = root != first
    return table("a bigint, b bigint", a=nodes[first[new]], b=nodes[root[new]])


_MEASURED = "region bigint, node bigint, links array<bigint>, goes array<bigint>, far boolean"


def _measure(members: pa.Table, pivots: pa.Table, percent: int) -> pa.Table:
    """Of each member of a part of a region: pivots that it links with, pivots whose Voronoi region or window it is in, and whether it is far.

    With eps the greatest distance of a link: a member is near a pivot if at most 2 eps away, and then its home is its nearest pivot's
    region. A partner of a near member is at most 3 eps from that pivot, and no more than 2 eps further from it than
    from its own nearest one; so a member goes to all regions within both bounds. Far members link with each other in a region of their own.
    """
    out: dict[str, list] = {"region": [], "node": [], "links": [], "goes": [], "far": []}
    if members.num_rows and pivots.num_rows:
        eps = 1.0 - percent / 100 + 1e-9
        nodes = members.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in members.column("grams").to_pylist()]
        size = np.array([len(s) for s in sets])
        flat, start = np.concatenate(sets), np.concatenate(([0], np.cumsum(size)[:-1]))
        names = pivots.column("p_node").to_numpy()
        distance, link = np.empty((len(names), len(nodes))), np.zeros((len(names), len(nodes)), bool)
        for k, raw in enumerate(pivots.column("p_grams").to_pylist()):
            s = np.frombuffer(raw, np.uint64)
            both = _overlaps(flat, start, s)
            union = size + len(s) - both
            distance[k] = 1.0 - both / union
            link[k] = (100 * both >= percent * union) & (nodes != names[k])
        nearest = distance.min(0)
        goes = (distance <= 3 * eps) & (distance - nearest <= 2 * eps)
        settled = np.isin(nodes, names)  # all links of a pivot are found, so it goes nowhere
        out["region"] = members.column("region").to_pylist()
        out["node"] = nodes
        out["links"] = [names[link[:, j]].tolist() for j in range(len(nodes))]
        out["goes"] = [[] if settled[j] else names[goes[:, j]].tolist() for j in range(len(nodes))]
        out["far"] = (nearest > 2 * eps) & ~settled
    return table(_MEASURED, **out)


def _split_regions(members: DataFrame, percent: int, most_bytes: int, most_members: int, pivots: int) -> DataFrame:
    """Links of regions (columns region, node, grams) by distributed recursion; small ones are joined in a task each.

    A round measures a region's members, in salted parts, against its pivots. Links found merge components; the regions of the
    next round are the Voronoi regions with their windows and the far members, each smaller by a share, so the rounds end. Where windows
    hold nearly everything, each two blocks of the region are joined in a task, and it is done. So is a region of a single component.
    """
    links = members.sparkSession.createDataFrame([], "a bigint, b bigint")
    where = cut_round(members.select("node").distinct().withColumn("component", F.col("node")))
    grams_of = members.select("node", "grams")  # each node is in one region at first
    while True:
        members = cut_round(members)
        sizes = cut_round(members.groupBy("region").agg(F.sum(F.length("grams")).alias("bytes"), F.count(F.lit(1)).alias("n")))
        fits = (F.col("bytes") <= most_bytes) & (F.col("n") <= most_members)
        small = members.join(sizes.where(fits).select("region"), "region", "left_semi")
        links = links.union(cut_round(small.groupBy("region").applyInArrow(lambda t: _join_region(t, percent), "a bigint, b bigint")))
        large = sizes.where(~fits)
        if large.limit(1).count() == 0:
            return links
        parts = F.greatest(F.ceil(F.col("bytes") / most_bytes), F.ceil(F.col("n") / most_members), F.lit(1)).cast("int")
        here = members.join(large.withColumn("parts", parts), "region").withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.col("parts").cast("bigint")).cast("int"))
        slot = F.pmod(F.xxhash64("node", "region"), F.lit(pivots))
        pick = here.groupBy("region", slot.alias("slot")).agg(F.min_by(F.struct("node", "grams", "parts"), F.xxhash64("region", "node")).alias("p")).select("region", "p.*")
        pick = cut_round(pick)
        spread = pick.select(F.col("region").alias("p_region"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p_salt"), F.col("node").alias("p_node"), F.col("grams").alias("p_grams"))
        measured = here.select("region", "salt", "node", "grams").groupBy("region", "salt").cogroup(spread.groupBy("p_region", "p_salt"))
        measured = cut_round(measured.applyInArrow(lambda m, p: _measure(m, p, percent), _MEASURED))
        found = cut_round(measured.select(F.col("node").alias("a"), F.explode("links").alias("b")))
        links = links.union(found)
        label = lambda end: where.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        between = found.join(label("a"), "a").join(label("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        merged = components(between).select(F.col("node").alias("component"), F.col("component").alias("wider"))
        where = cut_round(where.join(merged, "component", "left").select("node", F.coalesce("wider", "component").alias("component")))
        far = F.when(F.col("far"), F.array(F.lit(None).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        dealt = cut_round(measured.select("region", "node", F.explode(F.concat("goes", far)).alias("to")))
        spreads = dealt.groupBy("region", "to").agg(F.count(F.lit(1)).alias("k")).groupBy("region").agg(F.max("k").alias("most"), F.sum("k").alias("all"))
        splits = cut_round(large.join(spreads, "region", "left").select("region", F.coalesce((F.col("most") <= 0.7 * F.col("n")) & (F.col("all") <= 3 * F.col("n")), F.lit(True)).alias("splits")))
        apart = dealt.join(splits.where("splits"), "region", "left_semi").select(F.xxhash64("region", "to").alias("region"), "node")
        # two blocks meet in a task, and hold together what a region that is gathered may hold
        blocks = F.greatest(F.ceil(2 * F.col("bytes") / most_bytes), F.ceil(2 * F.col("n") / most_members)).cast("int")
        whole = members.join(large.join(splits.where("not splits"), "region").select("region", blocks.alias("blocks")), "region").join(where, "node")
        salted = whole.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks").cast("bigint")).cast("int"))
        met = salted.select("region", "salt", "node", "component", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
        met = met.withColumn("i", F.least("salt", "k")).withColumn("j", F.greatest("salt", "k")).drop("k")
        links = links.union(cut_round(met.groupBy("region", "i", "j").applyInArrow(lambda t: _join_blocks(t, percent), "a bigint, b bigint")))
        following = cut_round(apart.join(where, "node"))
        open_ = following.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("region")
        members = following.join(open_, "region", "left_semi").select("region", "node").join(grams_of, "node").select("region", "node", "grams")


def link_documents(docs: DataFrame, n: int = 5, percent: int = 75, max_region_bytes: int = 16_000_000, max_region_sets: int = 4000, pivots: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Connected components of documents whose n-word shingle sets have at least percent % Jaccard similarity.

    Returns id_col, n_shingles, component_id (smallest id reachable by links, itself included). Null texts
    and texts without words have an empty set and link with nothing; fewer than n words are one shingle; rows
    with equal ids count as one document; a null id has a null component and links nothing; other columns
    are ignored; an empty table gives an empty result. Sets are compared by 64-bit shingle hashes.
    """
    _, chars = text_volume(docs, text_col)
    buckets = bucket_count(chars)
    shards, blocks = buckets, block_count(chars / WORD_CHARS, buckets)
    dealt = docs.select(hash_bucket(buckets, id_col, text_col).alias("bucket"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = dealt.groupBy("bucket").applyInArrow(lambda t: _ask(t, shards, blocks, n), _ASK)
    answered = asked.groupBy("shard").applyInArrow(lambda t: _answer(t, shards, blocks), _ANSWER)
    sets = cut(dealt.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(lambda d, a: _sets(d, a, shards, blocks, n, percent), _SETS))

    # equal sets of all buckets: partial minima, so a hot group of copies is never gathered
    classes = cut(sets.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("node")))
    carriers = sets.where("grams is not null").select("cls", "grams", "cells")
    one = carriers.groupBy("cls").agg(F.max_by("grams", F.xxhash64("grams")).alias("grams"), F.max_by("cells", F.xxhash64("cells")).alias("cells"))
    some = cut(one.join(classes, "cls").select("node", "grams", "cells"))
    cell = some.select("node", F.explode("cells").alias("cell"))
    hubs = cell.groupBy("cell").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("cell", "hub")
    star = cell.join(hubs, "cell").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    regions = components(star).withColumnRenamed("component", "region")
    tied = cut(some.select("node", "grams").join(regions, "node"))
    links = _split_regions(tied.select("region", "node", "grams"), percent, max_region_bytes, max_region_sets, pivots)
    linked = components(links)
    # rows with equal ids are one document: a node's classes meet in its id
    own = sets.where("doc_id is not null").join(classes, "cls", "left").join(linked, "node", "left").select("doc_id", "n", F.coalesce("component", "node", "doc_id").alias("component_id"))
    nothing = sets.where("doc_id is null").select("doc_id", "n", F.lit(None).cast("bigint").alias("component_id"))
    kind = docs.schema[id_col].dataType
    return own.union(nothing).select(F.col("doc_id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"))
