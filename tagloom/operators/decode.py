"""The copy-or-tag automaton of constrained decoding, and the vocabulary join behind it.

A generated text may copy the source, open a requested tag, or close the open one. State is a function of
the generated text alone, so it is an Arrow function of a row; the tokens allowed next are vocabulary tokens that
are a prefix of one of the legal continuations, found by joining prefixes with the vocabulary.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.spans import tag_pattern

LEAST_ENTITY, LOOKAHEAD, PREFIX_CHARS, THINK_BUDGET = 2, 8, 64, 512
_UNFINISHED = "�"


def vocabulary(tokens: DataFrame, special: list[int] = ()) -> DataFrame:
    """token_id, token without special, empty and partial-character tokens."""
    keep = (F.col("token") != "") & ~F.contains(F.col("token"), F.lit(_UNFINISHED))
    return tokens.where(keep & ~F.col("token_id").isin(list(special)) if special else keep).select("token_id", "token")


def prefixes(text: Column, most: int = PREFIX_CHARS) -> Column:
    """All non-empty prefixes of at most `most` characters."""
    n = F.least(F.length(text), F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(text, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


def tokens_along(texts: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """Rows of texts times the tokens that are a prefix of their text: an equi-join of at most 64 prefixes a row."""
    return texts.withColumn("token", F.explode(prefixes(F.col(text)))).join(vocab, "token")


class Progress(NamedTuple):
    """How far a generated text has come: copied characters, open tag, where it opened, unfinished tag at the end, valid."""

    copied: int
    opened: str | None
    since: int
    pending: str = ""
    valid: bool = True


def agreed(run: str, source: str, at: int) -> int:
    """Length of the common prefix of run and source from at on."""
    if source.startswith(run, at):
        return len(run)
    low, high = 0, len(run)  # they agree on low characters and not on high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if source.startswith(run[:mid], at) else (low, mid)
    return low


def legal_tags(names: list[str], opened: str | None) -> list[str]:
    return [f"</{opened}>"] if opened is not None else [f"<{n}>" for n in names]


def replay(source: str, names: list[str], generated: str) -> Progress:
    """Progress of a generated text, run by run: between tags it must agree with the source, and tags must be legal.

    A tag with which the source itself goes on is part of the run, not markup.
    """
    parts = tag_pattern(names).split(generated)
    runs, tags = parts[::3], [f"<{slash}{name}>" for slash, name in zip(parts[1::3], parts[2::3], strict=True)]
    now, place = Progress(0, None, 0), 0  # place: characters of generated that now accounts for
    for k, run in enumerate(runs):
        literal = k > 0 and source.startswith(tags[k - 1], now.copied)
        if k and not literal:
            if tags[k - 1] not in legal_tags(names, now.opened):
                return now._replace(valid=False)
            place += len(tags[k - 1])
            now = now._replace(opened=None) if now.opened is not None else now._replace(opened=tags[k - 1][1:-1], since=now.copied)
        text = tags[k - 1] + run if literal else run
        n = agreed(text, source, now.copied)
        now, place = now._replace(copied=now.copied + n), place + n
        if n < len(text):
            rest = generated[place:]
            begun = any(tag.startswith(rest) for tag in legal_tags(names, now.opened))
            return now._replace(pending=rest if begun else "", valid=begun)
    return now


def continuations(source: str, names: list[str], generated: str) -> tuple[list[str], bool]:
    """Texts that may follow, and whether the end may: a tag goes into the rest of the source at each place where one may stand."""
    now = replay(source, names, generated)
    if not now.valid:
        return [], True
    rest = source[now.copied :]
    room, tags = len(rest), legal_tags(names, now.opened)
    if now.pending:
        finish = now.opened is not None or room >= LEAST_ENTITY
        texts = [tag.removeprefix(now.pending) + rest for tag in tags if finish and tag.startswith(now.pending)]
        return texts, not texts
    if now.opened is None:
        places = range(min(LOOKAHEAD, room - LEAST_ENTITY + 1))
    else:
        places = range(max(0, now.since + LEAST_ENTITY - now.copied), min(LOOKAHEAD, room) + 1)
    texts = [rest[:j] + tag + rest[j:] for j in places for tag in tags] + [rest] * (room > 0)
    return texts, not texts or room == 0 and now.opened is None


@F.pandas_udf(schemas.STATE)
def state(source: pd.Series, names: pd.Series, generated: pd.Series) -> pd.DataFrame:
    rows = [replay(s, list(n), g) for s, n, g in zip(source, names, generated, strict=True)]
    return pd.DataFrame(rows, columns=["copy_pos", "open_tag", "open_pos", "pending", "valid"])


@F.pandas_udf(T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("may_end", T.BooleanType())]))
def legal(source: pd.Series, names: pd.Series, generated: pd.Series) -> pd.DataFrame:
    rows = [continuations(s, list(n), g) for s, n, g in zip(source, names, generated, strict=True)]
    return pd.DataFrame({"texts": [[t[:PREFIX_CHARS] for t in a] for a, _ in rows], "may_end": [b for _, b in rows]})


def allowed_tokens(rows: DataFrame, vocab: DataFrame, end_id: int, key: str = "row_id") -> DataFrame:
    """key, token_id: every token that may come next for rows of key, source, names, generated.

    The end token is allowed once the source is copied and no tag is open, and wherever no other token is.
    """
    a = rows.select(key, legal("source", "names", "generated").alias("l"))
    found = tokens_along(a.select(key, F.explode("l.texts").alias("text")), vocab).select(key, "token_id").distinct()
    none = a.join(found.select(key).distinct(), key, "left_anti")
    ends = a.where("l.may_end").union(none).select(key).distinct().select(key, F.lit(end_id).cast("int").alias("token_id"))
    return found.union(ends).distinct()


def think_gate(phase: Column, allowed: Column, close: Column, free: Column) -> Column:
    """Ids allowed with a reasoning block: all while it is open, the closing mark once over budget, the automaton's after it."""
    return F.when(phase == "free", free).when(phase == "close", close).otherwise(allowed)
