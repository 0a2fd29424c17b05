"""Operator 4: token counts of a sentencepiece BPE model, by distinct pre-token.

No piece of the model has a word-start mark after another character, so no merge crosses the
place before a run of spaces. A text is therefore cut into pre-tokens "spaces + non-spaces";
the pieces of each distinct pre-token are counted once, and a text's count is the sum over its
pre-token frequencies of frequency x pieces. The library lists the ids of each distinct pre-token while it is
counted; ids of a document are never built. "Distinct" is by task: a table holds at most TABLE_LIMIT pre-tokens.

The join of (document, pre-token, frequency) with (pre-token, pieces) happens inside each task
against a bounded table of counts. Shuffling it instead would move about 80 million rows for
0.5 GB of documents, more than the documents themselves.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, utf8

#: Distinct pre-tokens that a task remembers; beyond it the table starts anew, counts stay the same.
TABLE_LIMIT = 400_000
_RUNS = re.compile(rb" *[^ ]+| +\Z")


class PieceCounter:
    """Counts pieces per text with a bounded table from pre-token to number of pieces."""

    def __init__(self, model_file: str, limit: int = TABLE_LIMIT):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of this model crosses the start of a word")
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))  # pieces of one space at the end
        self.table: dict[bytes, int] = {b"": self.lone}
        self.limit = limit

    @staticmethod
    def pretokens(text: bytes) -> list[bytes]:
        """Pre-tokens without the first of their spaces, which the model's dummy prefix stands for."""
        if not text:
            return []
        text = text.replace(b"\xe2\x96\x81", b" ")  # the model writes a space as this character
        if b"  " not in text and text[:1] != b" " and text[-1:] != b" ":
            return text.split(b" ")
        return [p[1:] for p in _RUNS.findall(b" " + text)]

    def counts(self, texts: list[bytes | None]) -> list[int]:
        frequencies = [Counter(self.pretokens(t or b"")) for t in texts]
        if len(self.table) > self.limit:
            self.table = {b"": self.lone}
        known = self.table
        new = list({p for f in frequencies for p in f if p not in known})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            known.update(zip(part, map(len, self.model.encode([p.decode() for p in part], num_threads=1)), strict=True))
        return [sum(n * known[p] for p, n in f.items()) for f in frequencies]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count of every whole text.

    Returns id_col, n_bytes, n_tokens, over_limit (n_tokens > limit). A null or empty text has 0
    bytes and 0 tokens; repeated rows and null ids give one row each; other columns of docs,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    state: dict[str, PieceCounter] = {}

    def run(batch):
        counter = state.setdefault("counter", None) or state.update(counter=PieceCounter(model_file)) or state["counter"]
        texts = utf8(batch.column(1))
        n = counter.counts(texts)
        return {"id": batch.column(0), "n_bytes": [len(t or b"") for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
