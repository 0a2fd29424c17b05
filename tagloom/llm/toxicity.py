"""Operator 9: toxicity from Levenshtein automata intersected with a lexicon trie.

The lexicon is learnt from a bounded sample of labelled rows: words, and stems shared by families of words, that
occur in toxic documents and hardly in others, each with its smoothed precision. The words form a trie;
running a Levenshtein automaton of one error along its edges and determinising the product gives one
table-driven automaton that recognises every lexicon word with at most one insertion, deletion or
substitution, and every stem as a prefix (a large lexicon takes several such automata). Distinct words of a batch run through it in numpy, one
character position at a time.

A hit inside a window that quotes or reports (a quotation open before and closed after it, or a word
of reporting just before it) speaks of abuse rather than utters it and counts less. The score is a logistic
function, fitted to the same sample, of the summed evidence of uttered hits and the length of the text; quoted
hits alone stay below one half.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, spans_by_bytes, utf8
from .shards import mix64

_WORD = re.compile(r"\w+")
_EDGE = re.compile(r"^\W+|\W+$")
STEM_LENGTHS = range(4, 10)
#: Default of Scorer(reporting): words that report what someone else said, in the languages of the corpus.
REPORTING = frozenset("said says called calls quote quoted quoting word words term slur insult dit appelle mot sagte nannte wort dijo llama palabra".split())
_OPEN, _CLOSE = re.compile("^\\W*[\"“”«„‘']"), re.compile("[\"”“»’']\\W*$")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Automaton:
    """Deterministic product of a lexicon trie with Levenshtein automata.

    words may match with one error if they have at least fuzzy_from characters; stems match as exact prefixes.
    run gives for each string the number of the matched entry (words first, then stems) and its errors: an exact
    word, else a stem, else the first word with an error.
    """

    def __init__(self, words: list[str], stems: list[str], fuzzy_from: int = 5):
        child: list[dict[str, int]] = [{}]
        ends: list[dict[int, int]] = [{}]  # per node: entry that ends here -> errors it may have
        stem_at: dict[int, int] = {}
        reach: list[int] = [0]  # errors allowed below the node

        def insert(s: str, errors: int) -> int:
            node = 0
            reach[0] = max(reach[0], errors)
            for c in s:
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    ends.append({})
                    reach.append(0)
                node = child[node][c]
                reach[node] = max(reach[node], errors)
            return node

        for k, w in enumerate(words):
            errors = int(len(w) >= fuzzy_from)
            ends[insert(w, errors)][k] = errors
        for k, s in enumerate(stems):
            stem_at.setdefault(insert(s, 0), len(words) + k)
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for node in child for c in node}))}  # 0: any other character

        def closure(states: set[tuple[int, int]]) -> frozenset:
            todo = list(states)
            while todo:  # a character of the lexicon word left out
                node, e = todo.pop()
                for below in child[node].values():
                    if e < reach[below] and (below, e + 1) not in states:
                        states.add((below, e + 1))
                        todo.append((below, e + 1))
            return frozenset(s for s in states if not any((s[0], e) in states for e in range(s[1])))

        def under(states: frozenset) -> int:
            """The stem met so far, which is in the state as node -1 - its number, or -1."""
            return next((-1 - n for n, _ in states if n < 0), next((stem_at[n] for n, e in states if e == 0 and n in stem_at), -1))

        start = closure({(0, 0)})
        number, table, self.entry, self.errors = {start: 0}, [], [], []
        queue = [start]
        letters = ["", *sorted(self.alphabet)]
        while queue:
            state = queue.pop(0)
            stem = under(state)
            whole = min(((e, k) for n, e in state if n >= 0 for k, most in ends[n].items() if e <= most), default=None)
            if stem >= 0:  # matches whatever follows, so only a covered word without an error can still take its place
                exact = next((n for n, e in state if n >= 0 and e == 0), None)
                self.entry.append(whole[1] if whole and whole[0] == 0 else stem)
                self.errors.append(0)
                row = []
                for c in letters:
                    target = frozenset({(-1 - stem, 0)} | ({(child[exact][c], 0)} if exact is not None and c in child[exact] else set()))
                    if target not in number:
                        number[target] = len(number)
                        queue.append(target)
                    row.append(number[target])
                table.append(row)
                continue
            self.entry.append(whole[1] if whole else -1)
            self.errors.append(whole[0] if whole else 0)
            row = []
            for c in letters:
                to: set[tuple[int, int]] = set()
                for node, e in state:
                    if c in child[node]:
                        to.add((child[node][c], e))
                    if e < reach[node]:
                        to.add((node, e + 1))  # a character too many
                    for below in child[node].values():
                        if e < reach[below]:
                            to.add((below, e + 1))  # another character
                target = closure(to)
                if target not in number:
                    number[target] = len(number)
                    queue.append(target)
                row.append(number[target])
            table.append(row)
        self.table = np.array(table, np.int32)
        self.entry, self.errors = np.array(self.entry, np.int32), np.array(self.errors, np.int8)
        self.codes = np.zeros(1 + max(map(ord, self.alphabet), default=0), np.int32)
        for c, i in self.alphabet.items():
            self.codes[ord(c)] = i

    def run(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, strings), np.int64, len(strings))
        order = np.argsort(-n, kind="stable")
        points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(points < len(self.codes), points, 0)
        letter = self.codes[points]
        first = (np.cumsum(n) - n)[order]
        length = n[order]
        state = np.zeros(len(strings), np.int32)
        for k in range(int(n.max(initial=0))):
            live = int(np.searchsorted(-length, -k, "left"))  # the first ones are longer than k
            if not live:
                break
            state[:live] = self.table[state[:live], letter[first[:live] + k]]
        out = np.empty(len(strings), np.int32)
        out[order] = state
        return self.entry[out], self.errors[out]


class Lexicon:
    """Automata for all words and stems, run one after another, with the results of one automaton for them all.

    A table has about four states a letter of the words and a column a character of the alphabet, so words go to
    one automaton until their letters times their alphabet reach most_cells.
    """

    def __init__(self, words: list[str], stems: list[str], most_cells: int = 100_000):
        parts: list[list[int]] = [[]]
        letters, alphabet = 0, set()
        for k in sorted(range(len(words)), key=lambda k: words[k]):  # words of one script go together
            if parts[-1] and (letters + len(words[k])) * len(alphabet | set(words[k])) > most_cells:
                parts.append([])
                letters, alphabet = 0, set()
            parts[-1].append(k)
            letters += len(words[k])
            alphabet |= set(words[k])
        self.size = len(words) + len(stems)
        self.parts = []
        for part in map(sorted, parts):
            self.parts.append((Automaton([words[k] for k in part], []), np.array(part, np.int64)))
        if stems:
            self.parts.append((Automaton([], stems), np.arange(len(words), self.size)))

    def run(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        none = 2 * self.size
        best = np.full(len(strings), none, np.int64)
        for automaton, numbers in self.parts:
            entry, errors = automaton.run(strings)
            hit = np.flatnonzero(entry >= 0)
            best[hit] = np.minimum(best[hit], errors[hit].astype(np.int64) * self.size + numbers[entry[hit]])
        found = best < none
        return np.where(found, best % max(1, self.size), -1).astype(np.int32), np.where(found, best // max(1, self.size), 0).astype(np.int8)


def _lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least: int, precision: float, least_ratio: float = 28.0) -> tuple[list[str], list[float], list[str], list[float]]:
    """Words and stems that occur in toxic documents and hardly in others, with smoothed precisions at equal class sizes."""

    def worth(term: str) -> float:
        p, q = toxic[term] / max(1, n_toxic), (clean.get(term, 0) + 0.3) / max(1, n_clean)
        return p / (p + q)

    share = n_toxic / max(1, n_toxic + n_clean)

    def sure(term: str) -> bool:
        """Precise, and by a likelihood ratio too one-sided to be chance among all terms of a corpus."""
        p, q = toxic[term], clean.get(term, 0)
        g = 2 * sum(x * math.log(x / ((p + q) * e)) for x, e in ((p, share), (q, 1 - share)) if x and e)
        return p >= least and worth(term) >= precision and g >= least_ratio

    words = sorted((t for t in toxic if t[0] != "^" and sure(t)), key=lambda t: (-toxic[t], t))
    longer: dict[str, list[str]] = {t: [] for t in toxic if t[0] == "^"}  # of each stem: the whole words and stems of one more letter
    for t in toxic:
        s = t[:-1] if t[0] == "^" else "^" + t[:-1]
        if s in longer:
            longer[s].append(t)
    stems, covered = [], []
    for s in sorted((t for t in toxic if t[0] == "^" and sure(t)), key=lambda t: (len(t), t)):
        stem = s[1:]
        widest = max((toxic.get(t, 0) for t in (stem, *longer[s])), default=0)
        if widest < 0.8 * toxic[s] and not stem.startswith(tuple(covered)):  # a family, not one word's beginning
            stems.append(stem)
            covered.append(stem)
    return words, [worth(w) for w in words], stems, [worth("^" + s) for s in stems]


def _one_of_each_group(rows: DataFrame) -> DataFrame:
    """One labelled text of each group that shares its smallest 5-word shingles under two hashes: words of a copied text count once.

    Near copies nearly always share both; texts that share a line or a notice only hardly ever do, and all of them count.
    """

    def run(batch):
        least = []
        for text in utf8(batch.column(1)):
            w = text.lower().split()
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
            n = max(1, len(h) - 4)
            g = np.zeros(n, np.uint64)
            for k in range(min(5, len(h))):
                g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
            one, two = (int((mix64(g + seed)).min()) for seed in (np.uint64(1), np.uint64(0xD6E8FEB86659FD93))) if len(h) else (0, 0)
            least.append((one * 31 + two) % (1 << 63))
        return {"_y": batch.column(0), "_t": batch.column(1), "_m": least}

    marked = map_batches(rows, run, "_y int, _t string, _m bigint")
    return cut(marked.groupBy("_y", "_m").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t")).drop("_m"))


def fit_lexicon(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, least: int = 4, precision: float = 0.95, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """Lexicon from at most sample_rows labelled rows, those with the smallest hashed ids.

    Returns (automaton, precision of each entry, words that look like lexicon words but are innocent, weights).
    """
    spark = docs.sparkSession
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_i")).agg(F.max(label_col).cast("int").alias("_y"))
    picked = one.orderBy(F.xxhash64(F.lit("toxicity sample"), F.col("_i"))).limit(sample_rows)  # bounded by sample_rows, so it may be broadcast
    rows = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(picked), F.col(id_col) == F.col("_i")).select("_y", F.col(text_col).alias("_t"))
    rows = _one_of_each_group(rows)
    classes = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    n_toxic = sum(n for y, n in classes.items() if y == 1)
    n_clean = sum(classes.values()) - n_toxic

    def terms(text: str) -> set[str]:
        words = set(words_of(text))
        return words | {"^" + w[:k] for w in words for k in STEM_LENGTHS if len(w) > k}

    def tally(select):
        def run(batch):
            count = Counter()
            for text in batch.column(0).to_pylist():
                count.update(select(text))
            return {"term": list(count), "n": list(count.values())}

        return run

    counted = lambda of, select: map_batches(of.select("_t"), tally(select), "term string, n bigint").groupBy("term").agg(F.sum("n").cast("bigint").alias("n"))
    found = counted(rows.where("_y = 1"), terms).where(F.col("n") >= least).collect()  # terms of at most sample_rows rows
    toxic = {r["term"]: r["n"] for r in found}
    wanted = spark.sparkContext.broadcast(frozenset(toxic))
    clean = {r["term"]: r["n"] for r in counted(rows.where("_y = 0"), lambda t: terms(t) & wanted.value).collect()}
    words, word_worth, stems, stem_worth = _lexicon(toxic, clean, n_toxic, n_clean, least, precision)
    automaton = Lexicon(words, stems)
    shared = spark.sparkContext.broadcast(automaton)

    def near(text: str) -> list[str]:
        own = list(set(words_of(text)))
        entry, errors = shared.value.run(own) if own else ((), ())
        return [w for w, k, e in zip(own, entry, errors, strict=True) if k >= 0 and e]

    innocent = frozenset(r["term"] for r in counted(rows.where("_y = 0"), near).collect())
    worth = np.array(word_worth + stem_worth)
    state: dict[str, Scorer] = {}

    def measure(batch):
        if not state:
            state["scorer"] = Scorer(shared.value, worth, innocent)
        found = state["scorer"].evidence(utf8(batch.column(1)))
        return {"y": batch.column(0), "c": [e[0] for e in found], "q": [e[1] for e in found], "n": [e[2] for e in found]}

    seen = map_batches(rows.select("_y", "_t"), measure, "y int, c double, q double, n bigint").where("c > 0").collect()  # at most sample_rows rows
    return automaton, worth, innocent, _calibration([(r["c"], r["q"], r["n"]) for r in seen], [r["y"] for r in seen])


class Scorer:
    """Scores texts; remembers a bounded number of distinct chunks.

    near_worth is the share of its precision that a misspelt term keeps; window the chunks around a hit in which a
    quotation may open and close; reporting the words that, just before a hit, report it; quoted_most the score that quoted or
    reported hits alone stay below.
    """

    def __init__(self, automaton: Automaton | Lexicon, worth: np.ndarray, innocent: frozenset, weights: tuple[float, float, float] = (0.0, 1.0, 0.0), near_worth: float = 0.9, window: int = 6, limit: int = 500_000, reporting: frozenset = REPORTING, quoted_most: float = 0.45):
        self.automaton, self.worth, self.innocent, self.weights = automaton, worth, innocent, weights
        self.near_worth, self.window, self.limit, self.reporting, self.quoted_most = near_worth, window, limit, reporting, quoted_most
        self.known: set[bytes] = set()
        self.hits: dict[bytes, float] = {}

    def learn(self, chunks: list[bytes]) -> None:
        names, owner = [], []
        for k, c in enumerate(chunks):
            t = c.decode().lower()
            own = _WORD.findall(t)
            trimmed = _EDGE.sub("", t)
            if len(own) > 1 and trimmed not in own:
                own.append(trimmed)  # a word with a mark inside it
            names += own
            owner += [k] * len(own)
        if not names:
            return
        entry, errors = self.automaton.run(names)
        for i in np.flatnonzero(entry >= 0):
            if errors[i] and names[i] in self.innocent:
                continue
            p = float(self.worth[entry[i]]) * (self.near_worth if errors[i] else 1.0)
            c = chunks[owner[i]]
            self.hits[c] = max(p, self.hits.get(c, 0.0))

    def _quoted(self, chunks: list[bytes], at: int) -> bool:
        before = [c.decode() for c in chunks[max(0, at - self.window) : at]]
        here = chunks[at].decode()
        after = [c.decode() for c in chunks[at + 1 : at + 1 + self.window]]
        if any(w in self.reporting for c in before[-3:] for w in words_of(c)):
            return True
        opened = bool(_OPEN.search(here)) or any(_OPEN.search(c) and not any(_CLOSE.search(x) for x in before[i:]) for i, c in enumerate(before))
        return opened and (bool(_CLOSE.search(here)) or any(_CLOSE.search(c) for c in after))

    def evidence(self, texts: list[bytes | None]) -> list[tuple[float, float, int]]:
        """Of each text: evidence of uttered hits, of quoted hits (sums of -log(1 - precision) over distinct chunks), words."""
        out = []
        for at, end in spans_by_bytes(texts):
            split = [(t or b"").split() for t in texts[at:end]]
            if len(self.known) > self.limit:
                self.known, self.hits = set(), {}
            new = list(set().union(*split) - self.known)
            for k in range(0, len(new), 50_000):
                self.learn(new[k : k + 50_000])
            self.known.update(new)
            for chunks in split:
                if self.hits.keys().isdisjoint(chunks):
                    out.append((0.0, 0.0, len(chunks)))
                    continue
                clear, quoted = {}, {}
                for i, c in enumerate(chunks):
                    p = self.hits.get(c)
                    if p is not None:
                        (quoted if self._quoted(chunks, i) else clear)[_EDGE.sub("", c.decode().lower())] = -math.log1p(-min(p, 0.995))
                out.append((sum(clear.values()), sum(quoted.values()), len(chunks)))
        return out

    def score(self, texts: list[bytes | None]) -> list[float]:
        return [self.calibrated(*e) for e in self.evidence(texts)]

    def calibrated(self, clear: float, quoted: float, n_words: int) -> float:
        if clear + quoted <= 0.0:
            return 0.01
        uttered = 0.0
        if clear > 0.0:
            bias, slope, length = self.weights
            uttered = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, bias + slope * clear + length * math.log1p(n_words)))))
        return max(0.01, uttered, self.quoted_most * (1.0 - math.exp(-quoted)))


def _calibration(rows: list[tuple[float, float, int]], toxic: list[int]) -> tuple[float, float, float]:
    """Logistic weights of (1, evidence, log words) by gradient steps; the noisy-or's own if there is but one class."""
    if len(set(toxic)) < 2:
        return (0.0, 1.0, 0.0)
    x = np.array([(c, math.log1p(n)) for c, _, n in rows])
    y = np.array(toxic, float)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(3)
    ridge = max(1e-3, 3 / len(y))  # few rows move the weights little
    for _ in range(3000):
        p = 1 / (1 + np.exp(-z @ w))
        w += 0.5 * (z.T @ (y - p) / len(y) - np.array([0.0, ridge, ridge]) * w)
    slope, length = max(0.05, w[1] / scale[0]), w[2] / scale[1]
    return (float(w[0] - slope * mean[0] - length * mean[1]), float(slope), float(length))


def score_toxicity(docs: DataFrame, labelled: DataFrame, labels: DataFrame, sample_rows: int = 20_000, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Toxicity of every whole text of docs, learnt from labelled joined with labels on id_col.

    Returns id_col, score, predicted (1 if score >= threshold). Null and empty texts, and all texts if no lexicon
    can be learnt, score 0.01. A document with several label rows counts as toxic if one says so; rows with
    a null id or label are not learnt from. Null ids and repeated rows of docs give one row each; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_lexicon(labelled, labels, sample_rows, id_col=id_col, text_col=text_col, label_col=label_col))
    state: dict[str, Scorer] = {}

    def run(batch):
        if not state:
            state["scorer"] = Scorer(*model.value)
        score = state["scorer"].score(utf8(batch.column(1)))
        return {"id": batch.column(0), "score": score, "predicted": [int(x >= threshold) for x in score]}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
