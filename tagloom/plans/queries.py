"""One registered query per operator of the inventory, over the driver tables.

The rule tagger annotates `documents`; predictions are gold with deterministic edits (dropped spans, short ends, swapped
labels, appended characters, lost closing tags).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import spans as S
from ..functions import text as X
from ..functions.sampling import draw
from ..operators import autopsy, converters, decode, jobs, mixture, probes, reward, scoring
from ..operators.tagger import rule_spans
from ..sources.files import first_rows, scan_parquet, union_sources
from ..streaming import serve

EDIT_SEED = 7
NAMES = [x.replace("_", " ") for x in L.RULE_LABELS]
MAPS = {f"src{i}": L.default_aliases(L.RULE_LABELS) for i in range(0, 20, 2)}  # odd sources are unknown: their names stay
AUDITOR = "You audit span annotations."
PRICES = {"large": (2.0, 8.0), "small": (0.4, 1.6), "nano": (0.1, 0.4)}
_SPANS = "array<struct<start:int,end:int,label:string>>"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, source, lang, text, spans.

    A table of fewer splits than cores, such as a single row group, is dealt out by id first: per-row work follows. Larger
    tables are read as they lie, without an exchange.
    """
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "source", "lang", "text")
    cores = spark.sparkContext.defaultParallelism
    rows = rows.repartition(cores, "row_id") if rows.rdd.getNumPartitions() < cores else rows
    return rows.withColumn("spans", rule_spans("text"))


def _named(spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.replace(s["label"], F.lit("_"), F.lit(" ")).alias("label")))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, source, text, spans, messages."""
    d = _docs(spark, sf_dir)
    user = X.render_request(F.array(*map(F.lit, NAMES)), F.col("text"))
    return d.withColumn("messages", X.chat(user, S.inject("text", _named("spans"))["tagged"]))


def _edited(row: Column, spans: str) -> Column:
    """Spans with deterministic errors."""
    edit = lambda i: F.pmod(draw(EDIT_SEED, row, "edit", i), F.lit(20))
    following = F.create_map(*[F.lit(x) for a, b in zip(L.RULE_LABELS, L.RULE_LABELS[1:] + L.RULE_LABELS[:1], strict=True) for x in (a, b)])
    changed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.when(edit(i) == 1, s["end"] - 1).otherwise(s["end"]).alias("end"), F.when(edit(i) == 2, F.element_at(following, s["label"])).otherwise(s["label"]).alias("label"), (edit(i) == 0).alias("gone")))
    return F.transform(F.filter(changed, lambda s: ~s["gone"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, output."""
    d = _docs(spark, sf_dir).withColumn("pred", _edited(F.col("row_id"), "spans"))
    d = d.withColumn("tagged", S.inject("text", _named("pred"))["tagged"]).withColumn("turn", F.pmod(draw(EDIT_SEED, F.col("row_id"), "row"), F.lit(20)))
    broken = F.regexp_replace("tagged", r"(?s)\A(.*)</[^<>]+>(.*?)\z", "$1$2")
    return d.select("row_id", F.when(F.col("turn") == 0, F.concat("tagged", F.lit("X"))).when(F.col("turn") == 1, broken).otherwise(F.col("tagged")).alias("output"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir).select("row_id", "source", "messages")
    return scoring.parsed_rows(scoring.positional_join(gold, _predictions(spark, sf_dir)), MAPS)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# scans and sources


def lang_slice(spark, sf_dir):
    """Language filter, pushed to the scan."""
    return _table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source")


def first_n_scan(spark, sf_dir):
    return first_rows(_table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id"), 100).select("row_id", "lang")


def upsample_union(spark, sf_dir):
    """Union of two sources, the second three times over."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    bench = mixture.upsample(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), "text"))
    both = union_sources({"documents": docs.withColumn("repeat", F.lit(0)), "benchmark": bench})
    return both.groupBy("source", "repeat").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def hash_sample_cap(spark, sf_dir):
    """The 150 rows with the smallest seeded draws."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "source")
    return mixture.seeded_cap(docs, mixture.SEED_V2 + 1, 150)


# spans and tags


def spans_found(spark, sf_dir):
    d = _docs(spark, sf_dir).select("row_id", F.posexplode("spans").alias("i", "s"))
    return d.select("row_id", "i", F.col("s.start").alias("b"), F.col("s.end").alias("e"), F.col("s.label").alias("label"))


def inject_tagged(spark, sf_dir):
    d = _docs(spark, sf_dir).select("row_id", S.inject("text", "spans")["tagged"].alias("t"))
    return d.select("row_id", F.length("t").cast("bigint").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("tagged_md5"))


def parse_roundtrip(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("p", S.parse(S.inject("text", "spans")["tagged"], F.array(*map(F.lit, L.RULE_LABELS))))
    return d.select("row_id", F.size("spans").cast("bigint").alias("n_spans"), (F.col("p.text") == F.col("text")).alias("same_text"), (F.col("p.spans") == F.col("spans")).alias("same_spans"))


def parse_faults(spark, sf_dir):
    """What the strict parser makes of predictions, by source."""
    p = _predictions(spark, sf_dir).join(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "source"), "row_id")
    return p.select("source", F.coalesce(S.parse("output", F.array(*map(F.lit, NAMES)))["reason"], F.lit("sound")).alias("reason")).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


def _stretched(spark, sf_dir):
    """Spans of which some end later than they should."""
    d = _docs(spark, sf_dir)
    longer = F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), F.when(F.pmod(draw(EDIT_SEED, F.col("row_id"), "long", i), F.lit(50)) == 0, F.least(s["end"] + 30, F.length("text"))).otherwise(s["end"]).alias("end"), s["label"].alias("label")))
    return d.withColumn("spans", longer)


def overlap_reject(spark, sf_dir):
    d = _stretched(spark, sf_dir).select("source", F.coalesce(S.inject("text", "spans")["reason"], F.lit("kept")).alias("reason"), S.overlapping(F.col("spans")).alias("native"))
    return d.groupBy("source", "reason", "native").agg(F.count(F.lit(1)).alias("n"))


def min_len_filter(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.explode(mixture.keep_spans(F.col("spans"), removed=["ipv4"], known=["email", "ipv4", "proper_word"], least=5)).alias("s"))
    return d.groupBy(F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def present_labels(spark, sf_dir):
    return _docs(spark, sf_dir).select("row_id", F.array_join(mixture.present_labels(F.col("spans")), ",").alias("labels"))


def faithfulness(spark, sf_dir):
    p = _predictions(spark, sf_dir).join(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text"), "row_id")
    return p.select("row_id", S.faithful(F.col("output"), F.array(*map(F.lit, NAMES)), F.col("text")).alias("faithful"))


def context_snippets(spark, sf_dir):
    d = _docs(spark, sf_dir).select("row_id", "text", F.posexplode("spans").alias("i", "s")).where("s.label <> 'proper_word'")
    return d.select("row_id", "i", S.snippet(F.col("text"), F.col("s.start"), F.col("s.end")).alias("snippet"))


# converters


def _masked(spark, sf_dir):
    """Documents as masked rows; some values are wrong."""
    d = _docs(spark, sf_dir).withColumn("bodies", S.bodies("text", "spans"))
    value = lambda s, i: F.when(F.pmod(draw(EDIT_SEED, F.col("row_id"), "value", i), F.lit(100)) == 0, F.lit("?")).otherwise(F.get("bodies", i))
    return d.select(F.col("text").alias("source_text"), F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), value(s, i).alias("value"), s["label"].alias("label"))).alias("privacy_mask"), F.col("lang").alias("language"), F.col("row_id").cast("string").alias("uid"))


def offset_validation(spark, sf_dir):
    c = converters.convert_masked(_masked(spark, sf_dir))
    return c.select("uid", "valid")


def conversion_counters(spark, sf_dir):
    return converters.quality_counters(converters.convert_masked(_masked(spark, sf_dir)))


def label_frequency(spark, sf_dir):
    return converters.label_frequency(converters.convert_masked(_masked(spark, sf_dir)))


def skip_reasons(spark, sf_dir):
    """Loose validation and injection of stretched, partly wrong spans."""
    d = _stretched(spark, sf_dir).withColumn("bodies", S.bodies("text", "spans"))
    value = lambda s, i: F.when(F.pmod(draw(EDIT_SEED, F.col("row_id"), "value", i), F.lit(100)) == 0, F.lit("?")).otherwise(F.upper(F.get("bodies", i)))
    valued = F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), value(s, i).alias("value"), s["label"].alias("label")))
    return converters.skip_reasons(converters.convert_valued(d.withColumn("spans", valued)))


def literal_spans(spark, sf_dir):
    """Spans written as Python literals and read back."""
    d = _docs(spark, sf_dir).withColumn("bodies", S.bodies("text", "spans"))
    one = lambda s, i: F.concat(F.lit("{'start': "), s["start"].cast("string"), F.lit(", 'end': "), s["end"].cast("string"), F.lit(", 'text': '"), F.get("bodies", i), F.lit("', 'label': '"), s["label"], F.lit("'}"))
    d = d.withColumn("raw", F.concat(F.lit("["), F.array_join(F.transform("spans", one), ", "), F.lit("]")))
    back = d.withColumn("back", converters.literal_spans("raw"))
    return back.select("row_id", F.size("back").cast("bigint").alias("n_spans"), F.coalesce(converters.plain(F.col("back")) == F.col("spans"), F.lit(False)).alias("same"))


def date_repair(spark, sf_dir):
    """Event times, half of them without the clock, all tagged date_time."""
    e = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("At "), F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd"))).alias("text"))
    spans = F.array(F.struct(F.lit(3).alias("start"), F.length("text").alias("end"), F.lit("date_time").alias("label")))
    e = e.withColumn("spans", mixture.repair_dates(spans, F.col("text")))
    return e.groupBy(F.get("spans", F.lit(0))["label"].alias("label")).agg(F.count(F.lit(1)).alias("n"))


# scoring


def canonical_labels(spark, sf_dir):
    d = _docs(spark, sf_dir).select("source", F.explode("spans.label").alias("name"))
    return d.select(L.canonical(F.col("source"), F.replace("name", F.lit("_"), F.lit(" ")), MAPS).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def positional_join(spark, sf_dir):
    gold = _gold(spark, sf_dir).select("row_id", "source", F.get("messages", F.lit(2))["content"].alias("target"))
    both = scoring.positional_join(gold, _predictions(spark, sf_dir))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target") == F.col("output")).alias("same"))


def exact_match_counts(spark, sf_dir):
    return scoring.tallied(_parsed(spark, sf_dir)).where(F.size("labels") > 0).select("row_id", "exact.*")


def relaxed_match_counts(spark, sf_dir):
    return scoring.tallied(_parsed(spark, sf_dir)).select("row_id", "relaxed.*")


def ops_counters(spark, sf_dir):
    return scoring.ops_counters(_parsed(spark, sf_dir))


def micro_prf(spark, sf_dir):
    return _rounded(scoring.micro(_parsed(spark, sf_dir)))


def prf_by_label(spark, sf_dir):
    return _rounded(scoring.by_label(_parsed(spark, sf_dir)))


def prf_by_source(spark, sf_dir):
    return _rounded(scoring.by_source(_parsed(spark, sf_dir)))


def scorer_self_test(spark, sf_dir):
    return scoring.self_test(_gold(spark, sf_dir).select("row_id", "source", "messages"), MAPS)


def autopsy_counts(spark, sf_dir):
    return autopsy.error_counts(autopsy.error_events(_parsed(spark, sf_dir)))


def autopsy_topk(spark, sf_dir):
    return autopsy.error_examples(autopsy.error_events(_parsed(spark, sf_dir)), 8)


def reward_scores(spark, sf_dir):
    gold = _gold(spark, sf_dir).select("row_id", F.get("messages", F.lit(2))["content"].alias("gold_tagged"), F.col("text").alias("source_text"))
    rows = gold.join(_predictions(spark, sf_dir), "row_id").withColumn("names", F.array(*map(F.lit, NAMES)))
    rows = rows.withColumn("completion", F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("<think>why</think>\n\n"), F.col("output"))).otherwise(F.col("output")))
    return reward.score(rows).select("row_id", F.round("reward", 6).alias("reward"))


# text functions


def _thoughts(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("head"))
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("  <think>a\nb</think>\n\n"), F.col("head"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("x\n<think>a</think> "), F.col("head"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("a</think>\n"), F.col("head"), F.lit("</think>z"))).otherwise(F.col("head"))
    return d.select("doc_id", text.alias("t"))


def _answer(text):
    """Length and digest of a text."""
    return F.length(text).cast("bigint").alias("n_chars"), F.md5(text.cast("binary")).alias("answer_md5")


def think_strip_a(spark, sf_dir):
    return _thoughts(spark, sf_dir).select("doc_id", *_answer(X.strip_think_line(F.col("t"))))


def think_strip_b(spark, sf_dir):
    return _thoughts(spark, sf_dir).select("doc_id", *_answer(X.strip_think_start(F.col("t"))))


def think_strip_c(spark, sf_dir):
    return _thoughts(spark, sf_dir).select("doc_id", *_answer(X.strip_think_end(F.col("t"))))


def think_gate(spark, sf_dir):
    t = _thoughts(spark, sf_dir)
    return t.select("doc_id", X.think_phase(F.col("t"), F.length("t"), 600).alias("phase"), *_answer(X.answer_slice(F.col("t"))))


def names_normalise(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.array(F.concat(F.lit(" "), F.upper("lang"), F.lit("\t")), F.col("source"), F.lit("  "), F.col("lang"), F.lit("E-Mail")).alias("names"))
    return d.select("doc_id", F.array_join(X.normal_names(F.col("names")), "|").alias("names"))


def request_roundtrip(spark, sf_dir):
    """Requests rendered and read back; every third text holds the delimiter itself."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(X.REQUEST_TEXT), "lang")).otherwise(F.col("source")).alias("t"))
    d = d.withColumn("u", X.render_request(F.array(F.lit("email"), F.lit("phone number")), F.col("t")))
    return d.select("doc_id", X.request_text(F.col("u")).alias("t"), F.array_join(X.request_names(F.col("u")), "|").alias("names"))


def output_budgets(spark, sf_dir):
    n = F.col("n_chars")
    return _table(spark, sf_dir, "documents").select("doc_id", *[X.output_budget(n, k).cast("bigint").alias(k) for k in ("baseline", "evaluate", "serve", "generate")])


def chat_triples(spark, sf_dir):
    """Conversations as ordered message lists."""
    c = _table(spark, sf_dir, "conversations")
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return m.select("conv_id", F.size("m").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), F.coalesce(x["text"], F.lit("")))), "\n").cast("binary")).alias("digest"))


# mixtures


def _planned(spark, sf_dir, version):
    seed = mixture.SEED_V1 if version == 1 else mixture.SEED_V2
    return mixture.outcomes(_sparse(spark, sf_dir), L.ALIASES, L.VOCABULARY, seed, version, L.DATE_FAMILY, L.FAMILIES, L.RULES if version == 2 else None)


def _sparse(spark, sf_dir):
    """Documents whose capitalised words are relabelled to the date family and to places, in every seventh row left out."""
    d = _docs(spark, sf_dir)
    date = F.element_at(F.array(*map(F.lit, L.DATE_FAMILY)), (F.pmod(F.col("row_id"), F.lit(4)) + 1).cast("int"))
    few = F.transform(F.filter("spans", lambda s: (s["label"] != "proper_word") | (F.pmod(F.col("row_id"), F.lit(7)) != 0)), lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when((s["label"] == "proper_word") & (i % 2 == 0), date).when(s["label"] == "proper_word", F.lit("city")).otherwise(s["label"]).alias("label")))
    return d.withColumn("spans", few)


def _plan(spark, sf_dir, version):
    seed = mixture.SEED_V1 if version == 1 else mixture.SEED_V2
    p = mixture.plan_requests(_sparse(spark, sf_dir), seed, L.VOCABULARY, L.DATE_FAMILY, L.FAMILIES, version)
    join = lambda c: F.array_join(c, ",").alias(c)
    return p.select("row_id", "bucket", join("present"), join("request"), join("target"), "relabel_birth")


def request_plan_v1(spark, sf_dir):
    return _plan(spark, sf_dir, 1)


def request_plan_v2(spark, sf_dir):
    return _plan(spark, sf_dir, 2)


def alias_pick(spark, sf_dir):
    """Aliases for all labels of the vocabulary; pages hold real markup, here as <any url> and <time mention>."""
    p = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<any url></time mention>"), "html")).otherwise(F.col("html")).alias("text"))
    return p.select("row_id", F.array_join(mixture.pick_aliases(mixture.SEED_V1, F.col("row_id"), F.array(*map(F.lit, L.VOCABULARY)), F.col("text"), L.ALIASES), ",", "?").alias("names"))


def negative_cap(spark, sf_dir):
    """Every source's rows without an email, card or address are negative."""
    d = _sparse(spark, sf_dir).select("source", "row_id", (F.size("spans") == 0).alias("negative"), (F.pmod(F.col("row_id"), F.lit(11)) != 0).alias("emits"))
    return mixture.cap_negatives(d, 0.10, 5).select("row_id", "kept")


def _digest(examples):
    content = lambda i: F.md5(F.get("messages", F.lit(i))["content"].cast("binary"))
    return examples.select("row_id", "source", content(1).alias("user_md5"), content(2).alias("assistant_md5"))


def mixture_v1(spark, sf_dir):
    return _digest(mixture.seeded_order(mixture.examples(_planned(spark, sf_dir, 1), "train"), mixture.SEED_V1))


def mixture_v2(spark, sf_dir):
    return _digest(mixture.seeded_order(mixture.examples(_planned(spark, sf_dir, 2)), mixture.SEED_V2))


def mixture_stats(spark, sf_dir):
    return mixture.statistics(_planned(spark, sf_dir, 1))


def emitted_limit(spark, sf_dir):
    """The first three emitted rows of each source."""
    return mixture.examples(_planned(spark, sf_dir, 1), "eval", 3).select("row_id", "source")


def containment_negatives(spark, sf_dir):
    """Requests for absent labels beside present ones, along the chains of the vocabulary."""
    n = probes.containment_negatives(_sparse(spark, sf_dir), L.CHAINS, mixture.SEED_V2)
    return n.select("row_id", "chain", "asked", F.md5(F.get("messages", F.lit(1))["content"].cast("binary")).alias("user_md5"))


def probe_axes(spark, sf_dir):
    """Scores by axis; every tenth row is without an axis."""
    axis = F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("axis"), (F.col("doc_id") % 3).cast("string")))
    axes = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), axis.alias("axis"))
    return _rounded(probes.by_axis(_parsed(spark, sf_dir), axes))


# batch jobs


def job_adjudicate(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("names", F.array(*map(F.lit, NAMES)))
    r = jobs.adjudication(d, AUDITOR)
    return r.select("row_id", "custom_id", F.col("body.model").alias("model"), F.col("body.max_completion_tokens").alias("max_tokens"), F.md5(F.get("body.messages", F.lit(1))["content"].cast("binary")).alias("user_md5"))


def _tagged_rows(spark, sf_dir):
    return _sparse(spark, sf_dir).select("row_id", S.inject("text", "spans")["tagged"].alias("text_xml"))


def job_audit(spark, sf_dir):
    r = jobs.audit(jobs.audit_candidates(_tagged_rows(spark, sf_dir)), 20260718, AUDITOR)
    return r.select("row_id", "custom_id", F.md5(F.get("body.messages", F.lit(1))["content"].cast("binary")).alias("user_md5"))


def job_aliases(spark, sf_dir):
    r = jobs.alias_expansion(L.alias_table(spark, {"default": L.ALIASES}), AUDITOR)
    return r.select("custom_id", F.get("body.messages", F.lit(1))["content"].alias("user"))


def job_synthesis(spark, sf_dir):
    families = [("dlog", "nano", 110, 800, "Write a log. "), ("form", "small", 70, 800, "Write a form. "), ("prose", "small", 70, 800, "Write prose. ")]
    r = jobs.synthesis(spark, families, L.VOCABULARY, 20260718, AUDITOR)
    return r.select("custom_id", F.col("body.model").alias("model"), F.md5(F.get("body.messages", F.lit(1))["content"].cast("binary")).alias("user_md5"))


def _priced(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("names", F.array(*map(F.lit, NAMES)))
    return jobs.costs(jobs.adjudication(d, AUDITOR, n=1 << 40), 350, PRICES)


def job_cost(spark, sf_dir):
    return _priced(spark, sf_dir).select("row_id", F.round("cost", 9).alias("cost"))


def job_cost_by_model(spark, sf_dir):
    mixed = _priced(spark, sf_dir).withColumn("body", F.struct(F.when(F.col("row_id") % 2 == 0, F.lit("nano")).otherwise(F.lit("small")).alias("model"), F.col("body.messages").alias("messages"), F.col("body.max_completion_tokens").alias("max_completion_tokens")))
    t = jobs.cost_by_model(jobs.costs(mixed, 350, PRICES))
    return t.select("model", "n", F.round("cost", 6).alias("cost"))


def job_trim(spark, sf_dir):
    """The rows of a job that fit a third of its cost."""
    priced = _priced(spark, sf_dir).select("row_id", "cost").cache()
    whole = priced.agg(F.sum("cost")).first()[0]
    return jobs.trim_single(priced, "row_id", whole / 3).select("row_id")


def job_trim_mixed(spark, sf_dir):
    priced = _priced(spark, sf_dir).select("row_id", "cost").cache()
    whole = priced.agg(F.sum("cost")).first()[0]
    return jobs.trim_mixed(priced, "row_id", whole * 0.75).select("row_id")


def usage_totals(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"), F.col("text").alias("output"), F.when(F.col("doc_id") % 17 == 0, F.lit("503")).alias("error"), F.col("n_chars").alias("prompt_tokens"), (F.col("n_chars") % 97).alias("completion_tokens"))
    return jobs.usage_totals(d)


def corrected_gold(spark, sf_dir):
    """Verdicts drop every fifth and relabel every seventh span."""
    d = _docs(spark, sf_dir)
    v = d.select("row_id", F.posexplode("spans").alias("i", "s")).withColumn("turn", F.pmod(draw(EDIT_SEED, F.col("row_id"), "verdict", F.col("i")), F.lit(35)))
    v = v.select("row_id", "i", F.when(F.col("turn") % 5 == 0, F.lit("not_entity")).when(F.col("turn") % 7 == 0, F.lit("wrong_label")).otherwise(F.lit("ok")).alias("v"), F.lit("fixed").alias("fix"))
    c = jobs.apply_verdicts(d, v).select(F.explode("spans").alias("s"))
    return c.groupBy(F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s.end") - F.col("s.start")).alias("chars"))


# decoding


def _vocab(spark, sf_dir):
    """A vocabulary of all one- to three-character pieces of language codes, sources and tags, and some whole words."""
    words = [*"abcdefghijklmnopqrstuvwxyz0123456789.<>/ _@ABCDEFGHIJKLMNOPQRSTUVWXYZ", "em", "ema", "<e", "<email>", "</", "</email>", " <", "th", "The", "on", "an", "a ", "an ", "er", "src"]
    return decode.vocabulary(spark.createDataFrame(list(enumerate(words)), "token_id int, token string"))


def prefix_tokens(spark, sf_dir):
    """Tokens that the beginning of each text may start with."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode.tokens_along(d, F.broadcast(_vocab(spark, sf_dir))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_id").alias("ids"))


def _states(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("source"), F.array(F.lit("email"), F.lit("name")).alias("names"))
    head = F.expr("substring(source, 1, cast(length(source) div 2 as int))")
    generated = F.when(F.col("row_id") % 5 == 0, head).when(F.col("row_id") % 5 == 1, F.concat(head, F.lit("<email>"))).when(F.col("row_id") % 5 == 2, F.concat(head, F.lit("<na"))).when(F.col("row_id") % 5 == 3, F.concat(F.lit("<name>"), F.col("source"), F.lit("</name>"))).otherwise(F.concat(head, F.lit("#")))
    return d.withColumn("generated", generated)


def automaton_state(spark, sf_dir):
    return _states(spark, sf_dir).select("row_id", decode.state("source", "names", "generated").alias("s")).select("row_id", "s.*")


def allowed_tokens(spark, sf_dir):
    a = decode.allowed_tokens(_states(spark, sf_dir), F.broadcast(_vocab(spark, sf_dir)), 1000)
    return a.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.sum("token_id").alias("ids"))


def tag_requests(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text"), F.array(F.lit(" EMAIL "), F.lit("phone number"), F.lit("email")).alias("entities"), F.lit(True).alias("constrained"))
    t = serve.tag_requests(d)
    return t.select("doc_id", "error", F.array_join("names", ",").alias("names"), "faithful", F.length("tagged").cast("bigint").alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    lang_slice, first_n_scan, upsample_union, hash_sample_cap, spans_found, inject_tagged, parse_roundtrip, parse_faults, overlap_reject, min_len_filter, present_labels, faithfulness, context_snippets,
    offset_validation, conversion_counters, label_frequency, skip_reasons, literal_spans, date_repair, canonical_labels, positional_join, exact_match_counts, relaxed_match_counts, ops_counters, micro_prf,
    prf_by_label, prf_by_source, scorer_self_test, autopsy_counts, autopsy_topk, reward_scores, think_strip_a, think_strip_b, think_strip_c, think_gate, names_normalise, request_roundtrip, output_budgets, chat_triples,
    request_plan_v1, request_plan_v2, alias_pick, negative_cap, mixture_v1, mixture_v2, mixture_stats, emitted_limit, containment_negatives, probe_axes, job_adjudicate, job_audit, job_aliases, job_synthesis, job_cost, job_cost_by_model, job_trim,
    job_trim_mixed, usage_totals, corrected_gold, prefix_tokens, automaton_state, allowed_tokens, tag_requests,
)}
