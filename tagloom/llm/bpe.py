"""Operator 6: BPE encoding and decoding in batched numpy merge rounds.

Distinct words of a batch are laid out as one flat array of symbols with a word number beside
each. A round forms the key (left symbol, right symbol) of every neighbouring pair, finds its
rank by binary search over the sorted keys of the merge table, takes the lowest rank of each
word, and merges all its occurrences from left to right, for all words at once. Rounds end when
no word has a known pair; a word costs as many rounds as it has distinct merges.

Text is split at ASCII white space first, which the tokenizer's own pattern never crosses. A worker keeps the
results of distinct chunks in a bounded table of two generations: when the young one is full it becomes
the old one, and chunks that are met again move back. Chunks are normalised and split into words, and each
distinct word of a batch is merged once.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, spans_by_bytes, utf8

#: Chunks in each of the two generations of a worker's table.
TABLE_LIMIT = 150_000
_SPACE = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable stand-in for each byte: itself if printable in Latin-1, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a word-end BPE model in a tokenizers .json file."""

    def __init__(self, file: str, limit: int = TABLE_LIMIT):
        spec = json.load(open(file, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_letters()
        self.inner = np.array([self.vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([self.vocab.get(c + self.end, -1) for c in letters], np.int64)
        if min(self.inner.min(), self.last.min()) < 0:
            raise ValueError("the vocabulary lacks a byte")
        self.width = np.int64(max(self.tokens) + 1)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([self.vocab[a] * int(self.width) + self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.decimal = {i: str(i) for i in self.tokens}
        self.limit = limit
        self.young: dict[bytes, tuple[int, bytes, bytes]] = {}  # chunk: number of ids, ids as text, decoded text
        self.old: dict[bytes, tuple[int, bytes, bytes]] = {}

    def normalise(self, chunk: str) -> str:
        """NFC, runs of white space to one space, lower case character by character."""
        if chunk.isascii():
            return chunk.lower()  # chunks hold no ASCII white space
        chunk = _SPACE.sub(" ", unicodedata.normalize("NFC", chunk))
        return chunk.lower() if "Σ" not in chunk else "".join(c.lower() for c in chunk)

    def words_of(self, chunk: str) -> list[str]:
        """The words that the tokenizer's pattern finds in a normalised chunk."""
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            return [chunk[:-1], chunk[-1]]
        return self.word.findall(chunk)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one flat array, and the first position of each word in it."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = np.concatenate(([0], np.cumsum(n)))
        sym = self.inner[raw]
        sym[start[1:] - 1] = self.last[raw[start[1:] - 1]]
        owner = np.repeat(np.arange(len(words)), n)
        done_sym, done_owner = [], []
        none = len(self.ranks)
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            low = np.minimum.reduceat(rank, first)
            low = np.repeat(low, np.diff(np.append(first, len(sym))))
            live = low < none
            if not live.all():
                done_sym.append(sym[~live])
                done_owner.append(owner[~live])
                sym, owner, rank, low = sym[live], owner[live], rank[live], low[live]
                if not len(sym):
                    break
            hit = rank == low
            # of overlapping hits in a run, every second one merges, from the left
            index = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
            hit &= (index - run) % 2 == 0
            sym = np.where(hit, self.merged[np.minimum(rank, none - 1)], sym)
            keep = ~np.append(False, hit[:-1])
            sym, owner = sym[keep], owner[keep]
        sym = np.concatenate(done_sym) if done_sym else sym
        owner = np.concatenate(done_owner) if done_owner else owner
        order = np.argsort(owner, kind="stable")
        return sym[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def learn(self, chunks: list[bytes]) -> None:
        """Encode distinct chunks that the table lacks."""
        for at in range(0, len(chunks), 20_000):
            part = chunks[at : at + 20_000]
            number: dict[str, int] = {}  # of each distinct word
            parts = []  # for each chunk: word numbers, or special ids below zero
            for c in part:
                items = []
                for k, piece in enumerate(self.special_split.split(c.decode()) if self.special and b"<" in c else (c.decode(),)):
                    if k % 2:
                        items.append(-1 - self.special[piece])
                    elif piece:
                        for w in self.words_of(self.normalise(piece)):
                            items.append(number.setdefault(w, len(number)))
                parts.append(items)
            words = [w.encode() for w in number]
            sym, start = self.merge(words) if words else (np.zeros(0, np.int64), np.zeros(1, np.int64))
            flat, start = sym.tolist(), start.tolist()
            spelt = []
            for k in range(len(words)):
                ids = flat[start[k] : start[k + 1]]
                spelt.append((len(ids), " ".join([self.decimal[i] for i in ids]).encode(), " ".join([self.tokens[i] for i in ids]).encode()))
            for c, items in zip(part, parts, strict=True):
                rows = [spelt[x] if x >= 0 else (1, self.decimal[-1 - x].encode(), self.tokens[-1 - x].encode()) for x in items]
                self.young[c] = rows[0] if len(rows) == 1 else (sum(r[0] for r in rows), b" ".join([r[1] for r in rows]), b" ".join([r[2] for r in rows]))

    def encode(self, texts: list[bytes | None]) -> list[tuple[int, bytes, bytes]]:
        """Of each text: number of ids, decimal ids joined by spaces, decoded text."""
        out = []
        for at, end in spans_by_bytes(texts):
            split = [(t or b"").split() for t in texts[at:end]]
            if len(self.young) > self.limit:
                self.old, self.young = self.young, {}
            need = set().union(*split).difference(self.young)
            again = [c for c in need if c in self.old]
            self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
            self.learn(list(need.difference(again)))
            known = self.young
            for ws in split:
                rows = [r for r in map(known.__getitem__, ws) if r[0]]
                out.append((sum([r[0] for r in rows]), b" ".join([r[1] for r in rows]), b" ".join([r[2] for r in rows])))
        return out


    def rest(self) -> None:
        """Between tasks the young generation is kept and the old one is not."""
        self.old = {}


_encoders: dict[str, WordBpe] = {}


def encoder(file: str) -> WordBpe:
    """The worker's encoder of a file; its table serves all tasks of the worker."""
    if file not in _encoders:
        _encoders[file] = WordBpe(file)
    return _encoders[file]


def bpe_round_trip(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, then decode the ids.

    Returns id_col, n_tokens, ids (array<int>), decoded. A null or empty text has no ids and decodes
    to an empty text; repeated rows and null ids give one row each; other columns are ignored.
    """
    return _mapped(docs, file, id_col, text_col, "n_tokens bigint, ids array<int>, decoded string", lambda n, ids, text: (n, [int(x) for x in ids.split()], text.decode()))


def bpe_digests(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As bpe_round_trip, with digests of the ids and of the decoded text in their place.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _mapped(docs, file, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda n, ids, text: (n, sha(ids), sha(text)))


def _mapped(docs, file, id_col, text_col, columns, shape) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batch):
        rows = [shape(*r) for r in encoder(file).encode(utf8(batch.column(1)))]
        return {"id": batch.column(0)} | {name: list(c) for name, c in zip(names, zip(*rows, strict=True), strict=True)}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"id {kind}, {columns}", lambda: encoder(file).rest()).withColumnRenamed("id", id_col)
