"""A rule tagger: the pluggable stand-in for a model, and the source of spans in the registered queries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas
from ..functions.sliced import sliced

# ASCII patterns without word boundaries, first match wins; they read alike in Python, Java and RE2.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "phone_number": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "credit_debit_card": r"[0-9]{16}",
    "proper_word": r"[A-Z][a-z]{2,}",
}
ANY = "|".join(PATTERNS.values())
_groups = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))


@sliced(schemas.SPANS_TYPE)
def rule_spans(text):
    """Spans of every pattern in the whole text, leftmost first."""
    return [[{"start": m.start(), "end": m.end(), "label": m.lastgroup} for m in _groups.finditer(t or "")] for t in text]


def label_of(body: Column) -> Column:
    """Label of a matched string."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(PATTERNS.items()):
        out = F.when(body.rlike(f"^(?:{pattern})$"), F.lit(label)).otherwise(out)
    return out
