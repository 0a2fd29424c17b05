"""Questions that buckets of documents ask of hash shards, shared by the duplicate operators.

Documents are dealt into buckets of bounded size by a hash of their id; the gram hashes of a
bucket, each once, are dealt into shards by their upper bits and sent as binary arrays; a shard
answers every bucket about its own array. A gram that occurs everywhere is one entry per bucket, so no key is hot.
"""

from __future__ import annotations

import numpy as np
import xxhash

A = np.uint64(0x9E3779B97F4A7C15)
B = np.uint64(0xC2B2AE3D27D4EB4F)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int, base: np.uint64 = A) -> np.ndarray:
    """Polynomial hash, mixed, of every n consecutive word hashes."""
    count = max(0, len(h) - n + 1)
    with np.errstate(over="ignore"):
        part, width, have, done = h, 1, np.zeros(0, np.uint64), 0
        power = base
        while True:  # binary powers of the window length: part covers width words, have covers done words
            if n & width:
                if done == 0:
                    have, done = part, width
                else:
                    length = len(h) - done - width + 1
                    if length <= 0:
                        return np.zeros(0, np.uint64)
                    have = have[:length] * power + part[done : done + length]
                    done += width
            if done == n:
                return mix64(have[:count])
            length = len(part) - width
            if length <= 0:
                return np.zeros(0, np.uint64)
            part = part[:length] * power + part[width : width + length]
            width *= 2
            power = power * power


#: Cells of one sketch block; a cell number within it takes two bytes.
BLOCK = 1 << 16


def block_count(entries: float, shards: int, spread: int = 4) -> int:
    """Blocks of a counter row with spread cells an entry, a multiple of the number of shards."""
    return shards * max(1, -(-int(spread * entries) // (BLOCK * shards)))


def pack(sorted_hashes: np.ndarray, shard: int, shards: int, blocks: int) -> tuple[bytes, bytes, bytes]:
    """A shard's part of an ascending array: entries per block, and two independent cells of each entry.

    The block is the entry's place in the hash space, so the order of the array tells it; a row of
    counters is addressed by block and cell.
    """
    each = blocks // shards
    width = (1 << 64) // blocks + 1
    edges = np.array([min((shard * each + k) * width, (1 << 64) - 1) for k in range(1, each)], np.uint64)
    at = np.concatenate(([0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]))
    first = (sorted_hashes & np.uint64(0xFFFF)).astype(np.uint16)
    second = ((sorted_hashes >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16)
    return np.diff(at).astype(np.uint32).tobytes(), first.tobytes(), second.tobytes()


def cells(per_block: bytes, cell: bytes) -> np.ndarray:
    n = np.frombuffer(per_block, np.uint32)
    return np.repeat(np.arange(len(n), dtype=np.int64) * BLOCK, n) + np.frombuffer(cell, np.uint16)


def split_bounds(sorted_hashes: np.ndarray, shards: int, blocks: int) -> np.ndarray:
    """Where each shard's part of an ascending array begins; shards are ranges of whole blocks of the hash space."""
    width = ((1 << 64) // blocks + 1) * (blocks // shards)
    edges = np.array([min(s * width, (1 << 64) - 1) for s in range(1, shards)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]))
