"""Operators that SQL cannot express, against independent plain-Python versions; streaming, sources and sinks."""

import ast
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tagloom.functions import labels as L
from tagloom.functions import text as X
from tagloom.operators import autopsy, converters, decode, jobs, mixture, reward, scoring
from tagloom.sources import files
from tagloom.streaming import serve

SPANS = "array<struct<start:int,end:int,label:string>>"
DIR = "/root/testdata/sf0.001"


def chat_rows(spark, rows):
    """rows: (row_id, source, text, gold, output) with names a, b."""
    df = spark.createDataFrame(rows, "row_id bigint, source string, text string, gold string, output string")
    return df.select("row_id", "source", X.chat(X.render_request(F.array(F.lit("a"), F.lit("b")), F.col("text")), F.col("gold")).alias("messages"), "output")


def test_scoring_by_hand(spark):
    rows = chat_rows(
        spark,
        [
            (0, "s", "xy z", "<a>x</a>y <b>z</b>", "<a>x</a>y <b>z</b>"),
            (1, "s", "xy z", "<a>x</a>y z", "<a>xy</a> z"),
            (2, "t", "xy z", "<a>x</a>y z", "<a>x</a>y zz"),
            (3, "t", "xy z", "<a>x</a>y z", "<a>xy z"),
            (4, "t", "", "", ""),
            (5, "t", "x", "<a>x</a>", None),
        ],
    )
    parsed = scoring.parsed_rows(rows, {"s": {"slug": ["a"]}})
    assert {r["row_id"]: r["bad"] for r in parsed.collect()} == {0: None, 1: None, 2: "copy_drift", 3: "malformed", 4: None, 5: "copy_drift"}
    m = {r["tally"]: (r["tp"], r["fp"], r["fn"]) for r in scoring.micro(parsed).collect()}
    assert m == {"strict_exact": (2, 1, 4), "strict_relaxed": (3, 0, 3), "parseable_exact": (2, 1, 1), "parseable_relaxed": (3, 0, 0)}
    assert {r["label"]: (r["support"], r["tp"]) for r in scoring.by_label(parsed).collect()} == {"s:slug": (2, 1), "s:b": (1, 1), "t:a": (3, 0)}
    assert {r["source"]: r["rows"] for r in scoring.by_source(parsed).collect()} == {"s": 2, "t": 4}
    assert scoring.metrics(parsed)["ops"] == {"rows": 6, "malformed": 1, "copy_drift": 2, "unrequested_tags": 0}
    assert scoring.report_lines(parsed)[1] == "malformed output      1 (16.7%)"
    order = [r["label"] for r in scoring.by_label(parsed).collect()]
    assert order[0] == "t:a" and set(order) == {"t:a", "s:slug", "s:b"}


def test_positional_join_counts(spark):
    a, b = spark.range(3).withColumnRenamed("id", "row_id"), spark.range(2).withColumnRenamed("id", "row_id")
    for gold, pred in ((a, b), (b, a)):
        with pytest.raises(Exception, match="prediction rows"):
            scoring.positional_join(gold, pred).collect()
    assert scoring.positional_join(a, a).count() == 3


def test_broken_gold_raises(spark):
    with pytest.raises(Exception, match="malformed gold"):
        scoring.parsed_rows(chat_rows(spark, [(0, "s", "x", "<a>x", "x")]), {}).select("gold").collect()


def test_autopsy(spark):
    rows = chat_rows(spark, [(0, "s", "one two three four", "<a>one</a> <a>two</a> <a>three</a> <b>four</b>", "<a>one</a> <b>two</b> <a>three four</a>"), (1, "s", "one two", "one two", "<a>one</a> two")])
    events = autopsy.error_events(scoring.parsed_rows(rows, {}))
    counts = {r["label"]: r.asDict() for r in autopsy.error_counts(events).collect()}
    assert counts["s:a"] == {"label": "s:a", "exact": 1, "boundary": 1, "miss": 0, "label_swap": 1, "spurious": 1}
    assert counts["s:b"] == {"label": "s:b", "exact": 0, "boundary": 0, "miss": 0, "label_swap": 1, "spurious": 1}
    top = {(r["label"], r["kind"]): (r["gold"], r["pred"]) for r in autopsy.error_examples(events, 1).collect()}
    assert top["s:a", "boundary"] == ("three", "three four") and top["s:a", "spurious"] == (None, "one") and top["s:a", "label_swap"] == ("two", "two")


def test_reward(spark):
    source, gold, names = "Reach Anita at anita.k@corp.io.", "Reach <person name>Anita</person name> at <email>anita.k@corp.io</email>.", ["person name", "email"]
    cases = [
        ("<think>reasoning</think>\n\n" + gold, gold, source, 1.0),
        (gold, gold, source, 1.0),
        ("Reach <person name>Anita</person name> at anita.k@corp.io.", gold, source, 2 / 3),
        (source, gold, source, 0.0),
        (gold.replace("corp.io", "corp.iXX"), gold, source, 0.0),
        ("Reach <person name>Anita at anita.k@corp.io.", gold, source, 0.0),
        (source, source, source, 1.0),
    ]
    df = spark.createDataFrame([(i, c, g, names, s) for i, (c, g, s, _) in enumerate(cases)], "id int, completion string, gold_tagged string, names array<string>, source_text string")
    got = {r["id"]: r["reward"] for r in reward.score(df).collect()}
    assert got == pytest.approx({i: w for i, (*_, w) in enumerate(cases)})


def walk(source, names, generated):
    """The automaton again, character by character, as a checker."""
    copied, opened, opened_at, rest = 0, None, 0, generated
    while rest:
        tag = next((t for n in sorted(names, key=len, reverse=True) for t in (f"<{n}>", f"</{n}>") if rest.startswith(t)), None)
        if tag and not source[copied:].startswith(tag):
            name = tag.strip("</>")
            if tag.startswith("</"):
                if opened != name:
                    return copied, opened, opened_at, "", False
                opened = None
            elif opened is not None:
                return copied, opened, opened_at, "", False
            else:
                opened, opened_at = name, copied
            rest = rest[len(tag) :]
        elif copied < len(source) and source[copied] == rest[0]:
            copied, rest = copied + 1, rest[1:]
        else:
            tags = [f"</{opened}>"] if opened is not None else [f"<{n}>" for n in names]
            ok = any(t != rest and t.startswith(rest) for t in tags)
            return copied, opened, opened_at, rest if ok else "", ok
    return copied, opened, opened_at, "", True


def test_automaton():
    rng = random.Random(5)
    names = ["a", "ab", "e mail"]
    parts = ["x", "y", "<a>", "</a>", "<ab>", "</ab>", "<", "</", "<e", "z", "</e mail>", "<e mail>"]
    for _ in range(4000):
        source = "".join(rng.choice(["x", "y", "z", "<a>", "<"]) for _ in range(rng.randint(0, 6)))
        generated = "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
        if rng.random() < 0.5:
            generated = source[: rng.randint(0, len(source))] + generated[:4]
        assert decode.replay(source, names, generated) == walk(source, names, generated), (source, generated)


def test_allowed(spark):
    words = ["R", "Re", "Rea", "x", "<", "<a", "<a>", "<a>R", "R<", " <", "</a>", "a", ">", "ea", "", "�"]
    vocab = decode.vocabulary(spark.createDataFrame(list(enumerate(words)), "token_id int, token string"), [3])
    rows = spark.createDataFrame([(0, "Reach", ["a"], ""), (1, "Reach", ["a"], "<a"), (2, "Reach", ["a"], "<a>R"), (3, "Re", ["a"], "Re"), (4, "Re", ["a"], "Q"), (5, "R", ["a"], "<")], "row_id int, source string, names array<string>, generated string")
    found = {}
    for r in decode.allowed_tokens(rows, vocab, 99).collect():
        found.setdefault(r["row_id"], set()).add("END" if r["token_id"] == 99 else words[r["token_id"]])
    assert found[0] == {"R", "Re", "Rea", "<", "<a", "<a>", "<a>R", "R<"}
    assert found[1] == {">"}
    assert found[2] == {"ea"}  # an entity has two characters at least
    assert found[3] == {"END"} and found[4] == {"END"}
    assert found[5] == {"END"}  # too little is left for an entity


def test_literal_spans(spark):
    raws = ["[{'start': 3, 'end': 5, 'text': 42, 'label': \"it's\"}]", "[{'start': 0, 'end': 1, 'text': None, 'label': 'a'}]", "[]", None, "[{'start': 1, 'end': 2, 'text': 'a\\'b', 'label': 'x'}]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string")
    got = {r["id"]: r["s"] for r in df.select("id", converters.literal_spans("raw").alias("s")).collect()}
    for i, raw in enumerate(raws):
        want = None if raw is None else [(s["start"], s["end"], str(s["text"]), s["label"]) for s in ast.literal_eval(raw)]
        assert (got[i] if got[i] is None else [(s["start"], s["end"], s["value"], s["label"]) for s in got[i]]) == want


def test_negative_cap(spark):
    rows = [("s", i, i % 2 == 0, True) for i in range(200)] + [("t", i, True, i != 0) for i in range(30)]
    df = spark.createDataFrame(rows, "source string, row_id int, negative boolean, emits boolean")
    got = mixture.cap_negatives(df, 0.10)
    assert got.where("source = 's' and kept and row_id % 2 = 0").count() == 20
    assert got.where("source = 't' and kept").count() == 20


def test_alias_collisions_between_labels(spark):
    aliases = {"x": ["one"], "y": ["one", "two"], "z": ["one"]}
    df = spark.createDataFrame([(1, ["x", "y"], "t"), (2, ["x", "z"], "t"), (3, ["x"], "a </one> b")], "row_id int, request array<string>, text string")
    got = {r["row_id"]: r["n"] for r in df.select("row_id", mixture.pick_aliases(1, F.col("row_id"), F.col("request"), F.col("text"), aliases).alias("n")).collect()}
    assert got == {1: ["one", "two"], 2: ["one", None], 3: [None]}


def test_mixture_invariants(spark):
    from tagloom.functions.spans import parse_strict
    from tagloom.plans import queries as Q

    for version in (1, 2):
        planned = Q._planned(spark, DIR, version)
        texts = {r["row_id"]: r["text"] for r in planned.select("row_id", "text").collect()}
        for r in mixture.examples(planned, "train").collect():
            user, target = r["messages"][1]["content"], r["messages"][2]["content"]
            head, text = user.split("\n\nText:\n", 1)
            names = [line[2:].split(": ")[0] for line in head.split("\n")[1:]]
            assert text == texts[r["row_id"]] and parse_strict(target, names)[0] == text
            assert len(set(names)) == len(names)
        stats = mixture.statistics(planned).collect()
        assert sum(r["rows"] for r in stats) == planned.where("fate = 'emitted'").count()


def test_date_family_moves_as_one(spark):
    from tagloom.plans import queries as Q

    for r in Q.request_plan_v1(spark, DIR).collect():
        present, target = set(filter(None, r["present"].split(","))), set(filter(None, r["target"].split(",")))
        family = present & set(L.DATE_FAMILY)
        assert target <= present and (not family or family <= target or not family & target)
        if r["bucket"] == "negatives" and family:
            assert set(r["request"].split(",")) & set(L.DATE_FAMILY) == family


def test_trims(spark):
    rows = [(i, 1.0 + (i % 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id int, cost double")
    n, costs = 500, [c for _, c in rows]
    while sum(costs[:n]) > 400 and n > 10:
        n = int(n * 400 / sum(costs[:n]) * 0.97)
    assert jobs.trim_single(df, "row_id", 400.0).count() == n
    left = list(rows)
    while sum(c for _, c in left) > 400:
        left = [x for i, x in enumerate(left) if i % 10]
    assert sorted(r[0] for r in jobs.trim_mixed(df, "row_id", 400.0).collect()) == [i for i, _ in left]


def test_costs(spark):
    message = [{"role": "user", "content": 'é"x'}]
    df = spark.createDataFrame([("nano", message)], "model string, messages array<struct<role:string,content:string>>").select(F.struct("model", "messages").alias("body"))
    want = len(json.dumps(message)) / 4 / 1e6 * 0.10 + 90 / 1e6 * 0.625
    assert jobs.costs(df, 90, {"nano": (0.10, 0.625)}).first()["cost"] == pytest.approx(want)


@pytest.mark.parametrize("text", ["  <think>a\nb</think>\n\nrest", "x\n<think>a</think> y <think>b</think>", "a</think>\nb</think>c", "plain", "", "x <think>q</think>"])
def test_think_strips(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(X.strip_think_line(F.col("t")), X.strip_think_start(F.col("t")), X.strip_think_end(F.col("t"))).first()
    assert row[0] == re.sub(r"^\s*<think>[\s\S]*?</think>\s*", "", text, count=1, flags=re.M)
    assert row[1] == re.sub(r"\A\s*<think>[\s\S]*?</think>\s*", "", text, count=1)
    assert row[2] == re.sub(r"\A[\s\S]*?</think>\s*", "", text, count=1)


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, "b", "x")], "row_id bigint, output string, error string")
    files.write_predictions(df, str(tmp_path), "a/b")
    lines = sorted(line for f in os.listdir(tmp_path / "a_b_preds") if f.startswith("part") for line in open(tmp_path / "a_b_preds" / f, encoding="utf-8"))
    assert json.loads(lines[0]) == {"row_id": 1, "output": "é", "error": None} and "é" in lines[0]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [(r["row_id"], r["a"]) for r in files.scan_numbered_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == [(0, 1), (2, 2)]
    import gzip

    with gzip.open(tmp_path / "y.jsonl.gz", "wt") as f:
        f.write('{"a": 3}\n')
    assert files.scan_json_lines(spark, str(tmp_path / "y.jsonl.gz"), "a int").collect()[0]["a"] == 3
    (tmp_path / "z.json").write_text('[\n{"a": 4}, {"a": 5}]')
    assert sorted(r["a"] for r in files.scan_records(spark, str(tmp_path / "z.json"), "a int").collect()) == [4, 5]
    files.write_sidecar(spark, {"n": 1}, str(tmp_path / "stats"))
    assert json.loads(spark.read.text(str(tmp_path / "stats")).first()[0]) == {"n": 1}


def test_serve_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"text": "mail a@b.org now", "entities": [" EMAIL", "email", ""], "constrained": true}\n{"text": " ", "entities": ["email"], "constrained": true}\n')
    requests = spark.readStream.schema("text string, entities array<string>, constrained boolean").json(str(tmp_path / "in"))
    got = []
    query = serve.serve(requests, lambda df, _: got.extend(df.collect()), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    by = {r["error"]: r for r in got}
    assert by[None]["tagged"] == "mail <email>a@b.org</email> now" and by[None]["faithful"] and list(by[None]["names"]) == ["email"]
    assert by[serve.BLANK]["tagged"] is None


def test_alias_files(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"_removed": {"d": ["JUNK"]}, "d": {"E_MAIL": ["e mail", "mail"], "_note": []}}))
    aliases, removed = L.load_aliases(str(tmp_path / "a.json"), "d")
    assert aliases == {"E_MAIL": ["e mail", "mail"]} and removed == ["JUNK"]
    assert L.merge_aliases(aliases, {"E_MAIL": ["mail", "post"]}) == {"E_MAIL": ["e mail", "mail", "post"]}
    assert L.default_aliases(["E_MAIL"]) == {"E_MAIL": ["e mail"]}


def test_ranking(spark):
    from tagloom.operators.ranking import ranked

    rng = random.Random(2)
    keys = [rng.choice([None, *range(50)]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(keys)), "id int, k int")
    got = {r["id"]: r["_n"] for r in ranked(df, "k", ties=("id",), ranges=7).collect()}
    order = sorted(range(500), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
    assert got == {i: n for n, i in enumerate(order, 1)}
    assert ranked(df.limit(0), "k").count() == 0


def test_renamed_and_capped(spark):
    rows = chat_rows(spark, [(0, "s", "xy z", "<a>x</a>y <b>z</b>", ""), (1, "s", "q", "q", "")])
    first = mixture.novel_names(rows, {"a": "new"}).where("row_id = 0").first()["messages"]
    assert first[1]["content"] == "Entity types:\n- new\n- b\n\nText:\nxy z" and first[2]["content"] == "<new>x</new>y <b>z</b>"
    mixed = mixture.anchor_mix({"x": (rows, 1), "y": (rows, 5)}, 3).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in mixed} == {"x": 1, "y": 2}
    traces = spark.createDataFrame([(i, "s" if i < 6 else "t", "a", "a" if i % 2 else "b") for i in range(10)], "row_id int, style string, commitment string, answer string")
    assert {r["style"]: r["count"] for r in mixture.consistent_traces(traces, 2, 1).groupBy("style").count().collect()} == {"s": 2, "t": 2}


def test_verdicts(spark):
    gold = spark.createDataFrame([(0, [{"start": 0, "end": 1, "label": "a"}, {"start": 2, "end": 3, "label": "b"}, {"start": 4, "end": 5, "label": "c"}]), (1, [])], f"row_id int, spans {SPANS}")
    answers = spark.createDataFrame([(0, '{"verdicts":[{"i":0,"v":"ok"},{"i":1,"v":"wrong_label","fix":"z"},{"i":2,"v":"not_entity"}]}')], "row_id int, answer string")
    got = {r["row_id"]: [(s["start"], s["label"]) for s in r["spans"]] for r in jobs.apply_verdicts(gold, jobs.parse_verdicts(answers)).collect()}
    assert got == {0: [(0, "a"), (2, "z")], 1: []}


def test_verdicts_on_boundaries_and_missed_spans(spark):
    text = "Ann Lee met Ann and Bo."
    gold = spark.createDataFrame([(0, text, [{"start": 4, "end": 7, "label": "name"}, {"start": 20, "end": 22, "label": "name"}])], f"row_id int, text string, spans {SPANS}")
    answer = '{"verdicts":[{"i":0,"v":"wrong_boundary","fix":"Ann Lee"},{"i":1,"v":"wrong_boundary","fix":"nowhere"}],"missed":[{"text":"Ann","label":"name"},{"text":"Zoe","label":"name"}]}'
    answers = spark.createDataFrame([(0, answer)], "row_id int, answer string")
    row = jobs.apply_verdicts(gold, jobs.parse_verdicts(answers), jobs.parse_missed(answers)).first()
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["Ann Lee", "Ann", "Bo"] and row["spans"][1]["start"] == 12


def test_attempts():
    request = {"model": "m", "max_completion_tokens": 5, "reasoning_effort": "low"}
    assert jobs.next_attempt(503, request, 0) == (request, 2.0) and jobs.next_attempt(429, request, 3) == (request, 16.0)
    older = jobs.next_attempt(400, request, 0)[0]
    assert older == {"model": "m", "max_tokens": 5, "reasoning_effort": "low"}
    assert jobs.next_attempt(400, older, 1)[0] == {"model": "m", "max_tokens": 5}
    assert jobs.next_attempt(404, request, 0)[0] is None and jobs.next_attempt(500, request, 4)[0] is None


def test_batch_jobs(spark):
    one = lambda model, n: spark.createDataFrame([(f"x-{i:03d}", model if i % 2 else "nano", [{"role": "user", "content": "abc" * 10}]) for i in range(n)], "custom_id string, model string, m array<struct<role:string,content:string>>").select("custom_id", F.struct("model", F.col("m").alias("messages")).alias("body"))
    prices = {"nano": (0.0, 1e6), "big": (0.0, 2e6)}
    out = jobs.batch_jobs({"A": one("nano", 100), "D": one("big", 100)}, {"A": 40.0, "D": 100.0}, {"A": 1, "D": 1}, prices)
    assert out["A"].agg(F.sum("cost")).first()[0] <= 40 and out["A"].count() >= 35
    assert out["D"].agg(F.sum("cost")).first()[0] <= 100 and out["D"].count() >= 50
