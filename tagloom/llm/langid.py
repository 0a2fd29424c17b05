"""Operator 3: language identification by multinomial naive Bayes over hashed character n-grams.

Character 1-, 2- and 3-grams of the lower-cased text, runs of anything but letters folded to one
space, are hashed into 2^bits counters. Counts per language are gathered in Spark from a bounded
sample of labelled rows; the smoothed log-probability matrix (2^bits x languages, float32) has
a size fixed by its parameters and is broadcast. Batches are scored in numpy: one gather per
language and n-gram order, summed per document.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

ORDERS = (1, 2, 3)
#: Anything but letters and the marks on them; numbers of all kinds, such as a half sign, are no letters.
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_PRIMES = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def folded(text: str | None) -> str:
    """Letters in lower case, everything between them one space; empty if there is no letter."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words and (words[0].isalpha() or _LETTER.search(words)) else ""


def gram_ids(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashed n-gram ids at each position; n differing seeds keep the orders apart."""
    h = np.full(max(0, len(codes) - n + 1), n, np.uint32)
    for k in range(n):
        h = (h ^ codes[k : len(codes) - n + 1 + k]) * _PRIMES[k]
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and where each text starts."""
    start = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), start


def fit_language_model(labelled: DataFrame, bits: int = 16, rows_per_language: int = 3000, alpha: float = 0.1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """Languages, log-priors and log-probability matrix from at most about rows_per_language rows of each language; one row is enough.

    Rows with a null language or text are not used. The sample is the rows whose hashed id falls
    below the share that the bound leaves for the language, so it is the same in every run.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros(0, np.float32), np.zeros((0, 1 << bits), np.float32)
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, rows_per_language / sizes[lang]))]), F.col(lang_col))
    u = F.pmod(F.xxhash64(F.lit("language sample"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(F.col(lang_col).isin(langs)).where(u < share).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    place = {lang: k for k, lang in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), 1 << bits), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, _ = code_points([folded(text)])
                for n in ORDERS:
                    total[place[lang]] += np.bincount(gram_ids(codes, n, bits), minlength=1 << bits)
        import pyarrow as pa

        k, g = np.nonzero(total)
        yield pa.record_batch({"k": pa.array(k, pa.int32()), "g": pa.array(g, pa.int32()), "n": pa.array(total[k, g])})

    # at most languages x 2^bits rows come back, whatever the size of the corpus
    counted = sample.mapInArrow(count, "k int, g int, n bigint").groupBy("k", "g").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(langs), 1 << bits), alpha)
    counts[counted["k"].to_numpy(), counted["g"].to_numpy()] += counted["n"].to_numpy()
    logp = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
    prior = np.log(np.array([sizes[lang] for lang in langs]) / sum(sizes[lang] for lang in langs)).astype(np.float32)
    return langs, prior, logp


def score_texts(texts: list[str | None], langs: list[str], prior: np.ndarray, logp: np.ndarray, bits: int) -> tuple[list[str], list[float]]:
    """Most likely language and its posterior probability for each text."""
    texts = [folded(t) for t in texts]
    label, score = ["und"] * len(texts), [0.0] * len(texts)
    at = 0
    while at < len(texts) and langs:
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= 1_000_000):  # arrays of bounded size
            size += len(texts[end])
            end += 1
        full = [k for k in range(at, end) if texts[k]]
        if full:
            codes, start = code_points([texts[k] for k in full])
            total = np.tile(prior.astype(np.float64), (len(full), 1))
            for n in ORDERS:
                ids = np.append(gram_ids(codes, n, bits), np.zeros(n - 1, np.uint32))
                last = np.maximum(start[1:] - (n - 1), start[:-1])  # grams do not cross texts
                keep = np.ones(len(codes), bool)
                for k in range(1, n):
                    keep[start[1:] - k] = False
                for j in range(len(langs)):
                    cum = np.where(keep, logp[j][ids], np.float32(0))
                    total[:, j] += np.add.reduceat(cum, start[:-1], dtype=np.float64) * (last > start[:-1])
            p = np.exp(total - total.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for k, b, x in zip(full, best.tolist(), p[np.arange(len(full)), best].tolist(), strict=True):
                label[k], score[k] = langs[b], x
        at = end
    return label, score


def identify_languages(docs: DataFrame, labelled: DataFrame, bits: int = 16, rows_per_language: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language of every whole text of docs, learnt from the text and language of labelled.

    Returns id_col, lang_pred, score (posterior probability). lang_pred is "und" with score 0 for
    null texts, texts without a letter, and every text if labelled has no usable row. Ties go to the first
    language in code-point order. Null ids and repeated rows give one row each; other columns are ignored.
    """
    spark = docs.sparkSession
    langs, prior, logp = fit_language_model(labelled, bits, rows_per_language, id_col=id_col, text_col=text_col, lang_col=lang_col)
    model = spark.sparkContext.broadcast((langs, prior, logp))

    def run(batch):
        label, score = score_texts(batch.column(1).to_pylist(), *model.value, bits)
        return {"id": batch.column(0), "lang_pred": label, "score": score}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
