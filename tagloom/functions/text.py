"""Requests, chat triples, reasoning blocks, names, budgets."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the instruction that every training example and request carries.
SYSTEM_PROMPT = (
    "You tag entities in text. Reproduce the user's text exactly, wrapping each "
    "entity that matches a requested type in XML tags, like <label>entity</label>. "
    "Use only the requested labels. Tag every match. If nothing matches, reproduce "
    "the text unchanged. Never alter, add, or omit any other characters."
)
# The parts of a rendered request.
REQUEST_HEAD = "Entity types:\n"
REQUEST_TEXT = "\n\nText:\n"


def render_request(lines: Column, text: Column) -> Column:
    """A request for the given lines (names, or names with rules) over text."""
    return F.concat(F.lit(REQUEST_HEAD), F.array_join(F.transform(lines, lambda n: F.concat(F.lit("- "), n)), "\n"), F.lit(REQUEST_TEXT), text)


def request_text(content: Column) -> Column:
    """The text of a request: all after the first delimiter."""
    return F.get(F.split(content, REQUEST_TEXT, 2), F.lit(1))


def request_names(content: Column) -> Column:
    """The names of a request: each line after the first, without its first two characters."""
    lines = F.split(F.get(F.split(content, REQUEST_TEXT, 2), F.lit(0)), "\n")
    return F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.substring(x, 3, 1 << 30))


def chat(user: Column, assistant: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", user), message("assistant", assistant))


def strip_think_line(text: Column) -> Column:
    """Without the first reasoning block that starts a line."""
    return F.regexp_replace(text, r"(?s)\A(.*?)((?m:^)\s*<think>.*?</think>\s*)(.*)\z", "$1$3")


def strip_think_start(text: Column) -> Column:
    """Without a reasoning block at the very start."""
    return F.regexp_replace(text, r"(?s)\A\s*<think>.*?</think>\s*", "")


def strip_think_end(text: Column) -> Column:
    """Without everything through the first closing mark, opened or not."""
    return F.regexp_replace(text, r"(?s)\A.*?</think>\s*", "")


def answer_slice(text: Column) -> Column:
    """What follows the reasoning block, without leading newlines; null while the block is open."""
    at = F.instr(text, "</think>")
    return F.when(at > 0, F.regexp_replace(F.substring(text, at + 8, F.length(text)), r"\A\n+", ""))


def think_phase(text: Column, n_tokens: Column, budget: int = 512) -> Column:
    """free while reasoning, close once the budget is spent, answer afterwards."""
    return F.when(F.instr(text, "</think>") > 0, F.lit("answer")).when(n_tokens >= budget, F.lit("close")).otherwise(F.lit("free"))


def normal_names(names: Column) -> Column:
    """Trimmed, lower-cased, without empty and repeated ones, in the caller's order."""
    trimmed = F.transform(names, lambda n: F.lower(F.regexp_replace(n, r"(?U)\A\s+|\s+\z", "")))
    return F.array_distinct(F.filter(trimmed, lambda n: n != ""))


def output_budget(chars: Column, kind: str) -> Column:
    """Token limits of an answer over a text of so many characters (or prompt tokens for evaluate and serve)."""
    whole = lambda x: F.floor(x).cast("int")
    rules = {  # fixed values
        "baseline": lambda: F.least(F.lit(16000), whole(chars / 2.5) + 1500),
        "evaluate": lambda: F.least(F.lit(6144), chars.cast("int") + 512),
        "serve": lambda: F.least(F.lit(6144), chars.cast("int") + 256),
        "generate": lambda: F.least(whole(chars / 2) + 512, F.lit(4096)),
    }
    return rules[kind]()


@F.pandas_udf(T.LongType())
def escaped_length(messages: pd.Series) -> pd.Series:
    """Length of the messages as ASCII-escaped JSON with ", " and ": " separators."""
    return pd.Series([len(json.dumps([{"role": m["role"], "content": m["content"]} for m in ms])) for ms in messages], dtype="int64")


def slug_words(slug: Column) -> Column:
    return F.replace(slug, F.lit("_"), F.lit(" "))
