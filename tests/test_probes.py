"""Negatives along chains of labels and scores by axis, against plain Python and by hand."""

import random

from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.operators import probes, scoring

SPANS = "array<struct<start:int,end:int,label:string>>"
CHAINS = [["city", "county", "state", "country"], ["first_name", "last_name"], ["date"]]


def test_containment_negatives(spark):
    rng = random.Random(5)
    labels = sorted({x for c in CHAINS for x in c} | {"email"})
    rows = [(i, None if i % 17 == 0 else "abc", None if i % 13 == 0 else [(0, 1, x) for x in rng.sample(labels, rng.randint(0, 5))]) for i in range(120)]
    df = spark.createDataFrame(rows, f"row_id bigint, text string, spans {SPANS}").withColumn("chain", F.lit("clash"))
    got = {(r["row_id"], r["chain"]): r for r in probes.containment_negatives(df, CHAINS, 3).collect()}
    want = {}
    for i, text, spans in rows:
        held = {x for *_, x in spans or ()}
        for k, chain in enumerate(CHAINS):
            edge = [x for j, x in enumerate(chain) if x not in held and held & {*chain[max(0, j - 1) : j], *chain[j + 1 : j + 2]}]
            if edge and text is not None:
                want[i, k] = edge
    assert got.keys() == want.keys() and want
    assert all(r["asked"] in want[key] for key, r in got.items())
    assert {r["asked"] for r in got.values()} >= {"city", "county", "state", "country"}
    for r in got.values():
        system, user, target = r["messages"]
        assert target["content"] == "abc" and user["content"] == X.REQUEST_HEAD + "- " + r["asked"].replace("_", " ") + X.REQUEST_TEXT + "abc"
    assert probes.containment_negatives(df.limit(0), CHAINS, 3).count() == 0


def test_by_axis(spark):
    rows = [
        (0, "s", "xy", "<a>x</a>y", "<a>x</a>y"),
        (1, "s", "xy", "xy", "xy"),
        (2, "s", "xy", "xy", "<a>x</a>y"),
        (3, "s", "xy", "xy", "xyz"),
        (4, "s", "xy", "<a>x</a>y", "xy"),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, source string, text string, gold string, output string")
    chat = df.select("row_id", "source", X.chat(X.render_request(F.array(F.lit("a")), F.col("text")), F.col("gold")).alias("messages"), "output")
    axes = spark.createDataFrame([(0, "names"), (1, "absence"), (2, "absence"), (3, "absence")], "row_id bigint, axis string")
    got = {r["axis"]: tuple(r)[1:8] for r in probes.by_axis(scoring.parsed_rows(chat, {}), axes).collect()}
    assert got == {"names": (1, 0, 0, 0, 1, 0, 0), "absence": (3, 1, 3, 1, 0, 1, 0), None: (1, 0, 0, 0, 0, 0, 1)}
