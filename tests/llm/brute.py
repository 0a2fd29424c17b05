"""Plain-Python versions of the operators, written from their contracts, for small fixtures."""

import hashlib
import math
from collections import Counter

import numpy as np
import xxhash


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def passages(rows, window=13):
    """rows: (id, text) -> list of (id, n_words, n_removed, kept) in the order of rows; null ids count as largest."""
    key = lambda i: math.inf if i is None else i
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, math.inf), key(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text, n=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(rows, percent=75, n=5):
    """(id, text) -> {id: (n_shingles of its rows, component)}; rows with equal ids are one node."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is None or j is None or not x or not y:
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def base(text):
    w = words(text)
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def verdicts(rows, tail=1e-6, coverage=0.5, steps=6, prior=30.0, resolution=(0.02, 0.05, 0.1, 0.1)):
    """(text, lang, source) -> (base..., base_failed, kept) per row: minimum covariance determinants, group by group."""
    stats = [base(t) for t, _, _ in rows]
    failed = [n < 50 or 100 * r > 50 * n for n, _, _, _, r in stats]
    x = np.array([(math.log((c + 500) / (n + 100)), math.log1p(20 * s / (c + 50)), math.log1p(d) / 4, 2 * r / (n + 10)) for n, c, s, d, r in stats]).reshape(-1, 4)
    group = {}
    for k, (_, lang, source) in enumerate(rows):
        if not failed[k]:
            group.setdefault((lang, source), []).append(k)
    group = {g: x[m] for g, m in group.items()}
    passing = [k for k in range(len(rows)) if not failed[k]]
    least = np.diag(np.square(resolution))
    exceed = lambda v, p: math.exp(-v / 2) * sum((v / 2) ** k / math.factorial(k) for k in range(p // 2))

    def quantile(tail):
        low, high = 0.0, 2000.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if exceed(mid, 4) > tail else (low, mid)
        return low

    factor = lambda share: share / (1 - exceed(quantile(1 - share), 6))
    rank = lambda v, q: np.sort(v, axis=0)[max(0, math.ceil(q * len(v)) - 1)]
    median = lambda v: (np.floor(rank(v, 0.5) * 1000) + 0.5) / 1000
    bucket = lambda d: np.floor(100 * np.log1p(100 * d))
    distance = lambda v, e: np.einsum("ij,ij->i", v - e[0], np.linalg.solve(e[1], (v - e[0]).T).T)

    def starts(v):
        m = median(v)
        scale = np.sqrt((1.4826 * median(np.abs(v - m))) ** 2 + np.square(resolution))
        z = (v - m) / scale
        t, u = np.tanh(z), z / np.sqrt((z**2).sum(1) + 1e-12)[:, None]
        out = [np.diag(scale**2)]
        for part in (t.T @ t / len(v) - np.outer(t.mean(0), t.mean(0)), u.T @ u / len(v)):
            d = np.sqrt(np.diag(part) + 1e-3)
            r = len(v) / (len(v) + prior) * part / np.outer(d, d)
            np.fill_diagonal(r, 1.0)
            out.append(np.outer(scale, scale) * r)
        return [(m, c) for c in out]

    def moments(v, share):
        m = v.mean(0)
        return len(v), m, factor(share) * (v.T @ v / len(v) - np.outer(m, m))

    def shrunk(own, whole):
        (n, m, c), (_, pm, pc) = own, whole
        w = n / (n + prior)
        return w * m + (1 - w) * pm, w * c + (1 - w) * pc + least

    if not passing:
        return [(*s, True, False) for s in stats]
    every = x[passing]
    members = {"all": every, **group}
    now = {g: starts(v) for g, v in members.items()}
    for _ in range(steps):
        raw = {}
        for g, v in members.items():
            for s in range(3):
                d = bucket(distance(v, now[g][s]))
                raw[g, s] = moments(v[d <= rank(d, coverage)], coverage)
        new = {g: [(raw[g, s][1], raw[g, s][2] + least) if g == "all" else shrunk(raw[g, s], raw["all", s]) for s in range(3)] for g in members}
        moved = max(abs(np.linalg.slogdet(new[g][s][1])[1] - np.linalg.slogdet(now[g][s][1])[1]) for g in members for s in range(3))
        now = new
        if moved <= 0.02:
            break
    last = {}
    for g, v in members.items():
        best = min(range(3), key=lambda s: (round(np.linalg.slogdet(now[g][s][1])[1], 9), s))
        inside = v[distance(v, now[g][best]) <= quantile(0.025)]
        if len(inside):
            last[g] = moments(inside, 0.975)
    out = []
    for k, (_, lang, source) in enumerate(rows):
        kept = not failed[k]
        if kept:
            own = shrunk(last[lang, source], last["all"]) if (lang, source) in last else (last["all"][1], last["all"][2] + least)
            kept = bool(distance(x[k : k + 1], own)[0] <= quantile(tail))
        out.append((*stats[k], failed[k], kept))
    return out


def poisson(u, rate):
    p = total = math.exp(-rate)
    k = 0
    while u >= total and k < 1000:
        k += 1
        p *= rate / k
        total += p
    return k


def mixed(rows, seed="mix-1", temperature=0.5, weights=None, other=0.0):
    """(id, source) -> list of (row number, copy, shuffle key) in global order; rates up to 64."""
    sizes = Counter(s for _, s in rows)
    weight = {s: n**temperature if weights is None else weights.get(s, other) for s, n in sizes.items()}
    whole = math.fsum(weight.values())
    out = []
    for k, (i, s) in enumerate(rows):
        name = "null" if i is None else str(i)
        u = int(hashlib.md5(f"{seed}|copies|{name}".encode()).hexdigest()[:12], 16) / 2**48
        n = poisson(u, weight[s] / whole * len(rows) / sizes[s])
        out += [(k, c, hashlib.md5(f"{seed}|order|{name}|{c}".encode()).hexdigest()[:16]) for c in range(n)]
    return sorted(out, key=lambda r: (r[2], rows[r[0]][0] or -1, r[1]))


def winnowed(text, k=8, w=8):
    """[(hash, position)] by the definition: every window, smallest hash, rightmost of equal ones."""
    units = [c for c in text or "" if c not in " \t\n\x0b\x0c\r"]
    h = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    if not h:
        return []
    h += [0] * (k - len(h))
    grams = []
    for i in range(len(h) - k + 1):
        g = 0
        for x in h[i : i + k]:  # rolls as g << 1 xor x, in 64 bits
            g = (g << 1) % (1 << 64) ^ x
        grams.append(g >> 32)
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        window = list(enumerate(grams))[i : i + w] if len(grams) < 100 else [(j, grams[j]) for j in range(i, min(i + w, len(grams)))]
        best = min(window, key=lambda p: (p[1], -p[0]))
        if not out or (best[1], best[0]) != out[-1]:
            out.append((best[1], best[0]))
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]
