"""Registered queries of the subpackage against their oracles, and the pipeline against a brute-force one."""

import os
import sys

import duckdb
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tagloom.llm.queries import ORACLE_SQL, OTHER_TARGET, QUERIES, TARGETS  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    assert rows
    if name in ORACLE_SQL:
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
        result = c.execute(ORACLE_SQL[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(repr, ([r[c] for c in columns] for r in rows))) == sorted(map(repr, map(list, result.fetchall())))


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    kept = [d for d, v in zip(docs, brute.verdicts([(t, lang, s) for _, t, lang, s in docs]), strict=True) if v[-1]]
    first = {i for i, _, c in brute.components([(i, t) for i, t, _, _ in kept]) if i == c}
    kept = [d for d in kept if d[0] in first]
    cut = brute.passages([(i, t) for i, t, _, _ in kept])
    kept = [(i, text, lang, s) for (i, _, lang, s), (_, n, gone, text) in zip(kept, cut, strict=True) if gone == 0 or gone < n]
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for k, _, _ in brute.mixed([(i, s) for i, _, _, s in kept], weights=TARGETS, other=OTHER_TARGET):
        ids = model.encode(kept[k][1], add_special_tokens=False).ids
        want.append((kept[k][0], len(ids), ids, model.decode(ids, skip_special_tokens=False)))
    got = [(r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in corpus_pipeline.run(spark, DIR).collect()]
    assert sorted(got) == sorted(want) and got


def test_stages(spark, tmp_path):
    """Each stage's output, written and read again, is the next one's input and has the columns of documents."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count()


def test_near_duplicates_lose_no_row_for_its_id(spark):
    text = [" ".join(f"{w}{k}" for w in "one two three four five six seven eight nine ten".split()) for k in range(4)]
    rows = [(1, text[0]), (1, text[1]), (2, text[1]), (None, text[2]), (None, text[3]), (None, text[3]), (3, text[2]), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()), key=str)
    assert got == sorted([(1, text[0]), (2, text[1]), (None, text[3]), (3, text[2]), (4, None), (4, "")], key=str)


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, "word " * 10, "en", None, 50), (3, "word " * 10, "en", None, 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, DIR).collect()
