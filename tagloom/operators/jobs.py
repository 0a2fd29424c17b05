"""Batch jobs for a language model: request structs, prices, trims to a budget, run accounting."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.sampling import between, draw, shuffled
from ..schemas import SPANS_TYPE
from .ranking import ranked

AUDIT_TARGETS = r"</(occupation|date|date_time|time|date_of_birth)>"
AUDIT_CHARS, AUDIT_ROWS, ADJUDICATED = 2600, 40_000, 300
# Fixed value: what job D asks of every document after its labels.
SYNTHESIS_RULES = "Tag only real values, never placeholders. Vary length (120-350 words), topic, formatting. Output the tagged document only. "


def request(custom_id: Column, model: Column, system: Column, user: Column, max_tokens: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(model.alias("model"), F.array(message("system", system), message("user", user)).alias("messages"), max_tokens.cast("int").alias("max_completion_tokens"))
    return F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))


def request_id(job: str, ordinal: Column, digits: int) -> Column:
    return F.format_string(f"{job}-%0{digits}d", ordinal)


@F.pandas_udf(T.StringType())
def gold_list(text: pd.Series, spans: pd.Series) -> pd.Series:
    """JSON list of {"i": number, "text": body, "label": label} of a row's spans, with a space after each mark, not escaped to ASCII."""
    row = lambda t, x: [{"i": k, "text": t[s["start"] : s["end"]], "label": s["label"]} for k, s in enumerate(x if x is not None else ())]
    return pd.Series([json.dumps(row(t or "", x), ensure_ascii=False) for t, x in zip(text, spans, strict=True)])


def adjudication(parsed: DataFrame, system: str, model: str = "large", n: int = ADJUDICATED) -> DataFrame:
    """Job A: one request for each of the first n gold rows (row_id, text, names, spans); no spans are a request too."""
    rows = parsed.where(F.col("row_id") < n)
    user = F.concat(F.lit("Requested labels: "), F.array_join("names", ", "), F.lit("\n\nDocument:\n"), F.col("text"), F.lit("\n\nGold spans:\n"), gold_list(F.col("text"), F.col("spans")))
    return rows.select("row_id", request(request_id("A", F.col("row_id"), 3), F.lit(model), F.lit(system), user, F.lit(700)).alias("request")).select("row_id", "request.*")


def audit_candidates(rows: DataFrame, text: str = "text_xml", most_chars: int = AUDIT_CHARS, targets: str = AUDIT_TARGETS) -> DataFrame:
    """Job B's rows: short texts with a tag of one of the audited labels."""
    return rows.where(F.col(text).rlike(targets) & (F.length(text) <= most_chars))


def audit(rows: DataFrame, seed: int, system: str, model: str = "nano", most: int = AUDIT_ROWS, text: str = "text_xml") -> DataFrame:
    """Job B: a request for each candidate in seeded order, up to most; numbered in that order.

    The order is global, so the numbering window runs over the at most `most` rows that the limit leaves.
    """
    picked = rows.withColumn("_k", draw(seed, F.col("row_id"), "audit")).orderBy("_k", "row_id").limit(most)
    ranked = picked.withColumn("_n", F.row_number().over(Window.orderBy("_k", "row_id")) - 1)
    return ranked.select("row_id", request(request_id("B", F.col("_n"), 5), F.lit(model), F.lit(system), F.col(text), F.lit(220)).alias("request")).select("row_id", "request.*")


def alias_expansion(aliases: DataFrame, system: str, model: str = "medium") -> DataFrame:
    """Job C: one request per dataset and label of an alias table."""
    per = aliases.groupBy("dataset", "slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "alias"))), lambda s: s["alias"]).alias("forms"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("forms", lambda a: F.concat(F.lit("'"), a, F.lit("'"))), ", "), F.lit("]"))
    user = F.concat(F.lit("Entity type: "), F.col("slug"), F.lit("\nExisting names: "), listed, F.lit("\nDescription context: PII detection."))
    return per.select(request(F.concat(F.lit("C-"), F.col("dataset"), F.lit("-"), F.col("slug")), F.lit(model), F.lit(system), user, F.lit(400)).alias("request")).select("request.*")


def synthesis(spark: SparkSession, families: list[tuple[str, str, int, int, str]], labels: list[str], seed: int, system: str) -> DataFrame:
    """Job D: count requests per family (tag, model, count, max_tokens, brief), each with 4 to 8 labels and a seed number."""
    table = spark.createDataFrame(families, "tag string, model string, count int, max_tokens int, brief string")
    rows = table.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i"))
    rows = rows.withColumn("key", F.concat_ws("-", F.col("tag"), F.col("i").cast("string")))
    picked = F.slice(shuffled(seed, F.col("key"), "label", F.array(*map(F.lit, labels))), 1, between(seed, F.col("key"), "labels", 4, F.lit(8)))
    names = F.array_join(F.transform(picked, X.slug_words), ", ")
    user = F.concat(F.col("brief"), F.lit("Wrap every entity matching these types in XML tags using exactly these tag names: "), names, F.lit(f". {SYNTHESIS_RULES}Seed: "), F.pmod(draw(seed, F.col("key"), "seed"), F.lit(1_000_000_001)).cast("string"))
    custom = F.concat(F.lit("D-"), F.col("tag"), F.format_string("-%04d", F.col("i")))
    return rows.select("tag", "i", request(custom, F.col("model"), F.lit(system), user, F.col("max_tokens")).alias("request")).select("tag", "i", "request.*")


def costs(requests: DataFrame, answer_tokens: int, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds cost: estimated dollars of one request at four characters of escaped JSON a token.

    prices: model -> dollars per million tokens read and written; a model that prices lacks has a null cost.
    """
    table = F.create_map(*[F.lit(x) for m, (i, o) in prices.items() for x in (m, f"{i}|{o}")])
    price = F.split(F.try_element_at(table, F.col("body.model")), r"\|")
    tokens = X.escaped_length("body.messages") / 4 / 1e6
    return requests.withColumn("cost", tokens * F.get(price, F.lit(0)).cast("double") + F.lit(answer_tokens / 1e6) * F.get(price, F.lit(1)).cast("double"))


def cost_by_model(priced: DataFrame) -> DataFrame:
    """Requests and cost per model, and in all (model null)."""
    return priced.rollup(F.col("body.model").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


def trim_single(priced: DataFrame, order: str, budget: float, least: int = 10) -> DataFrame:
    """The first rows of a single-model job that fit the budget.

    Each step cuts to the share budget / cost * 0.97 of the rows left, as long as the cost exceeds the budget and more than
    `least` rows are left; the cost of a prefix comes from one aggregation a step, a handful of steps.
    """
    rows = ranked(priced, order)
    n, cost = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("cost"), F.lit(0.0))).first()
    while cost > budget and n > least:
        n = int(n * budget / cost * 0.97)
        cost = rows.where(F.col("_n") <= n).agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
    return rows.where(F.col("_n") <= n).drop("_n")


def trim_mixed(priced: DataFrame, order: str, budget: float) -> DataFrame:
    """Rows of a mixed job without every tenth, the first included, again and again until they fit the budget.

    A row's number after a pass follows from its number before it, so rows are ranked once: of the numbers from 0, those
    divisible by ten go and n becomes n - n div 10 - 1.
    """
    rows = ranked(priced, order).withColumn("_n", F.col("_n") - 1)
    while rows.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0] > budget:
        rows = rows.where(F.col("_n") % 10 != 0).withColumn("_n", F.expr("_n - _n div 10 - 1"))
    return rows.drop("_n")


def batch_jobs(jobs: dict[str, DataFrame], budgets: dict[str, float], answer_tokens: dict[str, int], prices: dict[str, tuple[float, float]], order: str = "custom_id") -> dict[str, DataFrame]:
    """Every job priced and trimmed to its budget: one of a single model by its first rows, one of several by dropping every tenth."""
    out = {}
    for name, requests in jobs.items():
        priced = costs(requests, answer_tokens[name], prices).withColumn("_order", F.xxhash64(order) if order == "custom_id" else F.col(order))
        several = priced.select("body.model").distinct().limit(2).count() > 1
        out[name] = (trim_mixed if several else trim_single)(priced, "_order", budgets[name]).drop("_order")
    return out


def usage_totals(results: DataFrame) -> DataFrame:
    """model, n, failures, prompt_tokens, completion_tokens of prediction rows (model, output, error, prompt_tokens, completion_tokens); failed rows add no tokens.

    With a column seconds (begin and end of a run are not row data) the totals have seconds, the sum of the rows' times.
    """
    ok = F.col("error").isNull()
    time = [F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds")] if "seconds" in results.columns else []
    return results.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("failures"), *[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens")], *time)


@F.pandas_udf(SPANS_TYPE)
def _judge(text: pd.Series, spans: pd.Series, verdicts: pd.Series, missed: pd.Series) -> pd.Series:
    def row(t, spans, verdicts, missed):
        judged = {v["i"]: (v["v"], v["fix"]) for v in verdicts}
        out = []
        for i, s in enumerate(spans):
            v, fix = judged.get(i, ("ok", None))
            start, end, label = s["start"], s["end"], s["label"]
            if v == "not_entity":
                continue
            if v == "wrong_label":
                label = fix or label
            elif v == "wrong_boundary" and fix and t:
                places = [k for k in range(max(0, start - len(fix)), end + 1) if t.startswith(fix, k)]
                if places:
                    start = min(places, key=lambda k: (abs(k - start), k))
                    end = start + len(fix)
            out.append((start, end, label))
        for m in missed:
            at = (t or "").find(m["text"]) if m["text"] else -1
            while at >= 0 and any(at < e and s < at + len(m["text"]) for s, e, _ in out):
                at = t.find(m["text"], at + 1)
            if at >= 0:
                out.append((at, at + len(m["text"]), m["label"]))
        return [{"start": a, "end": b, "label": c} for a, b, c in sorted(out)]

    given = [[x if x is not None else () for x in c] for c in (spans, verdicts, missed)]
    return pd.Series([row(t, *r) for t, r in zip(text, zip(*given, strict=True), strict=True)])


def apply_verdicts(gold: DataFrame, verdicts: DataFrame, missed: DataFrame | None = None) -> DataFrame:
    """Corrected gold (row_id, text, spans): verdicts (row_id, i, v, fix) and missed spans (row_id, text, label).

    not_entity drops a span; wrong_label gives it the label fix; wrong_boundary moves it to the place of the text fix nearest
    to its start that touches it, and leaves it where there is none. A missed text becomes a span at its first place that no other span covers.
    """
    out = gold if "text" in gold.columns else gold.withColumn("text", F.lit(None).cast("string"))
    out = out.join(verdicts.groupBy("row_id").agg(F.collect_list(F.struct("i", "v", "fix")).alias("_v")), "row_id", "left")
    if missed is None:
        out = out.withColumn("_m", F.array().cast("array<struct<text:string,label:string>>"))
    else:
        out = out.join(missed.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("text", "label"))).alias("_m")), "row_id", "left")
    return out.withColumn("spans", _judge("text", "spans", "_v", "_m")).select(*gold.columns)


def retry_delays(attempts: int = 5, first: float = 2.0) -> list[float]:
    """Seconds to wait after each failed attempt: doubling from the first."""
    return [first * 2**k for k in range(attempts)]


# Answers of a service that are worth another attempt.
RETRY_STATUS = (429, 500, 502, 503)


def next_attempt(status: int, request: dict, attempt: int, attempts: int = 5) -> tuple[dict | None, float]:
    """The request to send after a failed attempt (from 0) and the seconds to wait before it; None if there is none.

    After 400 the newer name of the token limit gives way to the older one, then the reasoning effort is left out.
    """
    if attempt + 1 >= attempts:
        return None, 0.0
    if status in RETRY_STATUS:
        return request, retry_delays(attempts)[attempt]
    if status == 400 and "max_completion_tokens" in request:
        return {k if k != "max_completion_tokens" else "max_tokens": v for k, v in request.items()}, 0.0
    if status == 400 and "reasoning_effort" in request:
        return {k: v for k, v in request.items() if k != "reasoning_effort"}, 0.0
    return None, 0.0


_ANSWER = "verdicts array<struct<i: int, v: string, fix: string>>, missed array<struct<text: string, label: string>>"


def parse_verdicts(answers: DataFrame) -> DataFrame:
    """row_id, i, v, fix from JSON answers of job A."""
    return answers.select("row_id", F.explode(F.from_json("answer", _ANSWER)["verdicts"]).alias("v")).select("row_id", "v.*")


def parse_missed(answers: DataFrame) -> DataFrame:
    """row_id, text, label of the spans that answers of job A miss in gold."""
    return answers.select("row_id", F.explode(F.from_json("answer", _ANSWER)["missed"]).alias("m")).select("row_id", "m.*")


def to_lines(requests: DataFrame) -> DataFrame:
    """One JSON line per request, in the field order of the batch interface."""
    return requests.select(F.to_json(F.struct("custom_id", "method", "url", "body"), {"ignoreNullFields": "false"}).alias("value"))


def load_state(text: str) -> dict:
    """Batch state {job: {file_id, batch_id, status}}."""
    return json.loads(text)
