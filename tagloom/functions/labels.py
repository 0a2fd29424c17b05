"""Label vocabularies: aliases, families, rules. All are parameters; small defaults are stated here."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def default_aliases(slugs: list[str], forms: tuple[str, ...] = ("{}",)) -> dict[str, list[str]]:
    """Aliases by rule: each form around the slug's words in lower case. Real vocabularies come from load_aliases."""
    return {s: [f.format(s.lower().replace("_", " ")) for f in forms] for s in slugs}


# Labels of the registered queries: those of the rule tagger, and some that its words are relabelled to.
RULE_LABELS = ["email", "ipv4", "phone_number", "credit_debit_card", "proper_word"]
VOCABULARY = sorted([*RULE_LABELS, "age", "api_key", "city", "country", "county", "date", "date_of_birth", "date_time", "first_name", "last_name", "occupation", "postcode", "state", "time", "url"])
FAMILIES = [["date", "date_of_birth", "date_time", "time"], ["city", "country", "county", "postcode", "state"], ["first_name", "last_name"]]
#: Labels of which each is contained in, or akin to, the next.
CHAINS = [["city", "county", "state", "country"], ["time", "date_time", "date", "date_of_birth"], ["first_name", "last_name"]]
DATE_FAMILY = ["date", "date_of_birth", "date_time", "time"]
# Rules rendered in guided requests.
RULES = {
    "date": "a calendar date with no time component",
    "date_time": "must contain both a date and a clock time",
    "time": "a clock time alone",
    "date_of_birth": "a date explicitly denoting someone's birth",
    "occupation": "the person's full job title; exclude department names, document titles, and bare credentials",
}
ALIASES = default_aliases(VOCABULARY, ("{}", "{} mention", "any {}"))


def load_aliases(path: str, dataset: str) -> tuple[dict[str, list[str]], list[str]]:
    """(aliases, removed labels) of one dataset from a JSON file {dataset: {slug: [alias]}, "_removed": {dataset: [label]}}."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {s: list(a) for s, a in spec[dataset].items() if not s.startswith("_")}, list(spec.get("_removed", {}).get(dataset, []))


def merge_aliases(base: dict[str, list[str]], generated: dict[str, list[str]]) -> dict[str, list[str]]:
    """base with generated forms appended, repeats dropped."""
    return {s: list(dict.fromkeys([*forms, *generated.get(s, [])])) for s, forms in base.items()}


def alias_table(spark: SparkSession, datasets: dict[str, dict[str, list[str]]]) -> DataFrame:
    """dataset, slug, ord, alias: one row per alias, a dimension of bounded size."""
    rows = [(d, s, i, a) for d, slugs in datasets.items() for s, forms in slugs.items() for i, a in enumerate(forms)]
    return spark.createDataFrame(rows, "dataset string, slug string, ord int, alias string")


def alias_map(aliases: dict[str, list[str]]) -> Column:
    """slug -> array of aliases as a map literal."""
    return F.create_map(*[x for s, forms in aliases.items() for x in (F.lit(s), F.array(*map(F.lit, forms)))])


def slug_map(aliases: dict[str, list[str]]) -> Column:
    """alias -> slug as a map literal."""
    return F.create_map(*[F.lit(x) for s, forms in aliases.items() for a in forms for x in (a, s)])


def canonical(source: Column, name: Column, maps: dict[str, dict[str, list[str]]]) -> Column:
    """source:slug; source:name where source or alias is unknown."""
    slug = F.lit(None).cast("string")
    for dataset, aliases in maps.items():
        slug = F.when(source == dataset, F.try_element_at(slug_map(aliases), name)).otherwise(slug)
    return F.concat(source, F.lit(":"), F.coalesce(slug, name))


def families_of(label: Column, families: list[list[str]]) -> Column:
    """All labels that share a family with label."""
    out = F.array().cast("array<string>")
    for family in families:
        out = F.when(label.isin(family), F.array(*map(F.lit, family))).otherwise(out)
    return out
