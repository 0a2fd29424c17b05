"""The ten operators against brute force, exact round trips or held-out accuracy, and their edge cases."""

import hashlib
import os
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tagloom.llm import bpe, graph, html, jaccard_join, langid, mixing, quality, substring_dedup, tokens, toxicity, winnow  # noqa: E402
from tagloom.llm.shards import grams, word_hashes  # noqa: E402

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("id", "bucket", "shard", "n_words", "score", "copy", "shuffle_key", "kept", "fingerprint", "component_id", "n_tokens", "_text", "_t", "_g", "host", "found", "carry", "n_removed", "term", "_y", "h")


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def edge_rows():
    long = passage(1, 60)
    return [
        (1, long, "en", "a", 1), (2, "before " + long + " after", "en", "a", 1), (3, long, "en", None, 1), (3, long, "en", None, 1), (4, None, None, "a", None), (5, "", "en", "a", 0), (6, " \n\t ", "en", "a", 4),
        (7, "one two", "en", "b", 7), (8, "ONE two", "en", "b", 7), (None, long, "en", "a", 1), (9, passage(2, 5000), "de", "b", 1), (10, passage(2, 5000) + " x", "de", "b", 1), (11, "a " * 40, "fr", "b", 80),
        (12, "é漢😀 " + passage(3, 30), None, "b", 5), (13, "x" * 3000, "en", "c", 3000), (14, passage(4, 20) + " \x0b " + passage(1, 30), "en", "c", 1), (None, None, None, None, None), (15, "one two", "en", "b", 7),
    ]


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def by(rows):
    return sorted(rows, key=str)


# 1


def test_passages(edges, small, nothing):
    for df in (edges, small):
        got = substring_dedup.remove_repeated_passages(df)
        assert by(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == by(brute.passages(pairs(df)))
    assert substring_dedup.remove_repeated_passages(nothing).count() == 0


def test_passages_carry(edges):
    got = substring_dedup.remove_repeated_passages(edges, carry=("lang", "source", "n_chars"))
    assert by(tuple(r) for r in got.select("doc_id", "lang", "source", "n_chars").collect()) == by((i, lang, s, n) for i, _, lang, s, n in edge_rows())


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 3000, 2000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(3)]
    shards, blocks = 4, 4  # far too narrow on purpose
    docs = [substring_dedup.pack, substring_dedup.split_bounds]
    asked = {}
    for k, p in enumerate(parts):
        at = docs[1](p, shards, blocks)
        for s in range(shards):
            asked.setdefault(s, []).append((k, p[at[s] : at[s + 1]], docs[0](p[at[s] : at[s + 1]], s, shards, blocks)))
    truth = {h: sum(h in set(p.tolist()) for p in parts) for p in parts for h in p.tolist()}
    for s, rows in asked.items():
        t = substring_dedup.table(substring_dedup._ASK, shard=[s] * len(rows), bucket=[k for k, _, _ in rows], n=[x[0] for _, _, x in rows], a=[x[1] for _, _, x in rows], b=[x[2] for _, _, x in rows])
        answer = substring_dedup._estimate(t, shards, blocks)
        for (_, p, _), bits in zip(rows, answer.column("bits").to_pylist(), strict=True):
            flag = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(p))
            assert all(f for h, f in zip(p.tolist(), flag, strict=True) if truth[h] > 1)


def test_grams():
    h = word_hashes([b"a", b"b", b"c", b"d", b"a", b"b", b"c"])
    for n in range(1, 9):
        g = grams(h, n)
        assert len(g) == max(0, 7 - n + 1)
        assert len(set(g.tolist())) == len({(b"a b c d a b c".split()[k : k + n]).__repr__() for k in range(len(g))})


# 2

PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><article>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>'
    "<article><header><h1>Head &amp; &eacute;</h1></header><p><b>one<br>two<p>three &lt;b&gt;\n  four</p><aside>side</aside><form><input>f</form><div class='comments'><p>nice</p></div><p>five&nbsp;six &#8212;</article><footer>&copy; x</footer>"
)


def test_page():
    assert html.Page(PAGE).text(set()) == "Head & é one two three <b> four five six —"
    assert html.Page("").text(set()) == "" and html.Page(None).text(set()) == ""
    assert html.Page("plain &amp text").text(set()) == "plain & text"
    assert html.Page("<main><p>a</p><article class=comment>no</article></main><p>b").text(set()) == "a"
    assert html.Page("<div hidden>no</div><p>a<p>b").text(set()) == "a b"
    assert html.Page("<div class='main has-sidebar'><p>a</p><div class='sidebar'>b</div></div>").text(set()) == "a"
    assert html.Page("<p>a < b <script>x").text(set()) == "a < b"


def test_templates(spark):
    boiler = "<div><p>Welcome to our site</p><ul><li>A</li><li>B</li></ul></div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{boiler}<div><p>Text {i} of its own</p></div></body>") for i in range(30)]
    rows += [(100 + i, f"http://g.example/{i}", f"<body>{boiler if i == 0 else ''}<p>Other {i}</p></body>") for i in range(12)]
    rows += [(200, None, None), (201, "http://h.example/x", ""), (None, "no url", "<p>x</p>"), (202, "http://h.example/y", f"<article><p>Welcome to our site</p><p>{'w ' * 3000}</p></article>"), (202, "http://h.example/y", "<p>Same id")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    for limit in (500_000, 0):  # by broadcast, and by the join beyond its bound
        got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html.extract_text(df, broadcast_rows=limit).where("page_id is null or page_id <> 202").collect()}
        assert got[5, "http://h.example/5"][0] == "Text 5 of its own"
        assert got[100, "http://g.example/0"][0] == "Welcome to our site A B Other 0"
        assert got[200, None] == ("", 0) and got[201, "http://h.example/x"] == ("", 0) and got[None, "no url"] == ("x", 1)
        kept = html.extract_text(df, broadcast_rows=limit).where("page_id = 202").collect()
        assert sorted(r["n_chars"] for r in kept) == [7, 19 + 1 + 5999]
    assert html.extract_text(df.limit(0)).count() == 0


def test_templates_inside_articles(spark):
    """A box on every page of a host goes; an article that is copied, whole or with an edit, stays whole."""
    box = "<div class='more'><p>Read more of this</p><p>Tell a friend</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<body><article><h1>Title {i}</h1><p>{passage(i, 30)}</p>{box}<p>Second {i}</p></article></body>") for i in range(30)]
    rows += [(100 + i, f"http://h.example/c{i}", f"<body><article><h1>Copied</h1><p>{passage(99, 40)}</p>{box}<p>{passage(98, 20)}</p><p>Edit {i % 15}</p></article></body>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Title {i} {passage(i, 30)} Second {i}" for i in range(30))
    assert all(got[100 + i] == f"Copied {passage(99, 40)} {passage(98, 20)} Edit {i % 15}" for i in range(30))


def test_template_counts_against_brute_force(spark):
    """Per host: different surroundings of every subtree, counted in plain Python over parsed pages."""
    boxes = [f"<div class='b{k}'><p>Box {k}</p><p>more of {k}</p></div>" for k in range(4)]
    rows = []
    for i in range(120):
        rng = random.Random(i)
        own = f"<p>{passage(i % 90, 25)}</p>"
        body = (rng.choice(boxes) + own + rng.choice(boxes)) if i % 3 else f"<article>{own}{rng.choice(boxes)}<p>The.</p></article>{rng.choice(boxes)}"
        rows.append((i, f"http://h{i % 2}.example/{i}", f"<html><body>{body}</body></html>"))
    seen, pages, within = {}, {}, set()
    for i, url, source in rows:
        host, page = url.split("/")[2], html.Page(source)
        pages[host] = pages.get(host, 0) + 1
        within |= {html._signed(h) for h, a in zip(page.subtrees, page.inside, strict=True) if a}
        for k, h in enumerate(page.subtrees):
            others = [(len(t), t) for t, held, *_ in page.blocks if k not in held and (not page.inside[k] or any(page.inside[x] == page.inside[k] for x in held))]
            if others:
                seen.setdefault((host, html._signed(h)), set()).add(sorted(others, key=lambda o: (-o[0], o[1]))[0][1])
    want = {key: len(s) for key, s in seen.items() if len(s) >= 10 and (key[1] not in within or len(s) >= 0.2 * pages[key[0]])}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {(r["host"], r["subtree"]): r["n_pages"] for r in html.template_subtrees(df).collect()} == want and len(want) >= 8
    text = {r["page_id"]: r["text"] for r in html.extract_text(df).collect()}
    assert all(text[i] == passage(i % 90, 25) for i in range(120) if i % 3)
    assert text[1] != html.Page(rows[1][2]).text(set())  # without the templates the boxes would stay


def test_subtrees_hold_text_of_open_inline_elements():
    one, two = (html.Page(f"<article><p><b>{t}<p>same</article>") for t in ("one", "two"))
    assert one.subtrees[1] != two.subtrees[1] and one.subtrees[2] == two.subtrees[2]


def test_pages_table(spark):
    import html as entities
    import re

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages).collect()}
    for r in pages.collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = (entities.unescape(re.sub(r"<[^>]*>", " ", b)).split() for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r["page_id"]] == " ".join(" ".join(b) for b in blocks if b)


# 3


def test_languages(spark, edges, nothing):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    out = langid.identify_languages(docs, docs.where("doc_id % 4 <> 2")).join(docs.where("doc_id % 4 = 2").select("doc_id", "lang"), "doc_id")
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()
    got = langid.identify_languages(edges, docs)
    assert got.count() == len(edge_rows())
    for r in got.collect():
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (4, 5, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.identify_languages(nothing, docs).count() == 0
    assert {r["lang_pred"] for r in langid.identify_languages(docs, docs.limit(0)).collect()} == {"und"}


def test_texts_without_a_letter():
    for t in ("", None, "²", "½ ²", "12 _ %", "٣ ⅷ"):
        assert langid.folded(t) == "" or any(c.isalpha() for c in t)
    assert langid.folded("²") == langid.folded("½ ²") == langid.folded("12_3") == ""
    assert langid.folded("Ab²c, é") == " ab c é "


def test_language_model_by_hand(spark):
    """Counts, priors and log-probabilities from their definition; one row of a language is enough."""
    rows = [(1, "ab ab c", "x"), (2, "Ba", "x"), (3, "zz", "y"), (4, None, "y"), (5, "q", None)]
    langs, prior, logp = langid.fit_language_model(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), bits=10)
    counts = {"x": np.full(1 << 10, 0.1), "y": np.full(1 << 10, 0.1)}
    for _, text, lang in rows[:3]:
        codes, _ = langid.code_points([langid.folded(text)])
        for n in langid.ORDERS:
            for k in range(len(codes) - n + 1):
                counts[lang][int(langid.gram_ids(codes[k : k + n], n, 10)[0])] += 1
    assert langs == ["x", "y"] and prior == pytest.approx(np.log([2 / 3, 1 / 3]))
    for j, lang in enumerate(langs):
        assert logp[j] == pytest.approx(np.log(counts[lang] / counts[lang].sum()), rel=1e-5)
    assert {r["lang_pred"] for r in langid.identify_languages(spark.createDataFrame([(9, "zz")], "doc_id bigint, text string"), spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()} == {"y"}


def test_language_scores_by_hand():
    langs, prior, bits = ["a", "b"], np.log(np.array([0.5, 0.5], np.float32)), 12
    rng = np.random.default_rng(2)
    logp = np.log(rng.dirichlet(np.ones(1 << bits), 2)).astype(np.float32)
    texts = ["Ab cd", "é", "", None, "12", "x" * 50, "zz yy xx"]
    label, score = langid.score_texts(texts, langs, prior, logp, bits)
    for t, got, s in zip(texts, label, score, strict=True):
        f = langid.folded(t)
        if not f:
            assert (got, s) == ("und", 0.0)
            continue
        codes, _ = langid.code_points([f])
        total = prior.astype(float) + sum(logp[:, langid.gram_ids(codes, n, bits)].astype(float).sum(1) for n in langid.ORDERS)
        p = np.exp(total - total.max())
        assert got == langs[int(total.argmax())] and s == pytest.approx(p.max() / p.sum(), rel=1e-5)


# 4 and 6

ODD = ["a", "B", " ", "  ", "\n", "\t", "\r", "é", "é", "漢", "<s>", "</s>", "▁", "　", "the", "ing", "😀", "}\r", "<0x41>", "<|endoftext|>", "'s", "'LL", "Σ", "İ", "\x00", "\x1c", "\x85", "\xa0", "٣", "!!", "ﬁ", "ß", "aaaa", "²", "が"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_token_counts(edges, nothing):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    texts = odd_texts(5000, 1)
    assert tokens.PieceCounter(file, limit=50).counts([t.encode() for t in texts]) == [len(x) for x in model.encode(texts)]
    got = tokens.count_tokens(edges, file)
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, *_ in edge_rows()]
    assert by(tuple(r) for r in got.collect()) == by(want)
    assert tokens.count_tokens(nothing, file).count() == 0


def test_bpe(edges, nothing):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(file)

    def want(t):
        ids = model.encode(t or "", add_special_tokens=False).ids
        return ids, model.decode(ids, skip_special_tokens=False)

    mine = bpe.WordBpe(file, limit=50)
    texts = odd_texts(5000, 2)
    for t, (n, ids, decoded) in zip(texts, mine.encode([t.encode() for t in texts]), strict=True):
        assert ([int(x) for x in ids.split()], decoded.decode()) == want(t) and n == len(ids.split())
    got = bpe.bpe_round_trip(edges, file)
    assert by((r["doc_id"], r["ids"], r["decoded"]) for r in got.collect()) == by((i, *want(t)) for i, t, *_ in edge_rows())
    digests = {r["doc_id"]: r["ids_sha256"] for r in bpe.bpe_digests(edges, file).collect()}
    assert digests[7] == hashlib.sha256(" ".join(map(str, want("one two")[0])).encode()).hexdigest()
    assert bpe.bpe_round_trip(nothing, file).count() == 0


# 5


def test_quality(spark, edges, nothing):
    medium = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    for df in (edges, medium):
        rows = df.select("doc_id", "text", "lang", "source").collect()
        got = quality.quality_verdicts(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        want = [(r["doc_id"], *v) for r, v in zip(rows, brute.verdicts([(r["text"], r["lang"], r["source"]) for r in rows]), strict=True)]
        assert by(tuple(r) for r in got.collect()) == by(want)
    assert quality.quality_verdicts(nothing).count() == 0


def test_repeated_windows_are_exact_where_hashes_clash(edges, small):
    """With a hash of a few bits nearly all windows clash; the words decide."""
    for df in (edges, small):
        rows = df.select("doc_id", "text").collect()
        got = quality.base_statistics(df, F.col("text"), [F.col("doc_id")], hash_bits=12).select("doc_id", "n_words", "n_repeat_words")
        assert by(tuple(r) for r in got.collect()) == by((r["doc_id"], brute.base(r["text"])[0], brute.base(r["text"])[4]) for r in rows)


def test_chi_square():
    assert quality.chi2_quantile(0.5) == pytest.approx(3.3567, abs=1e-4) and quality.chi2_quantile(0.025) == pytest.approx(11.1433, abs=1e-4)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200_000, 4))
    near = v[(v**2).sum(1) <= quality.chi2_quantile(0.5)]
    assert np.diag(quality.consistency(0.5) * np.cov(near.T)) == pytest.approx(np.ones(4), abs=0.03)


def test_small_groups_lean_on_the_whole(spark):
    """A junk row that is alone in its language and source is rejected, a clean one is not."""
    clean = [(i, passage(i, 100 + i % 300), "en", "s", 1) for i in range(300)]
    alone = [(1000, " ".join(f"{w}%%% &|" for w in passage(7, 200).split()), "en", "other", 1), (1001, passage(8, 150), "de", "s", 1)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(clean + alone, SCHEMA)).collect()}
    assert not got[1000] and got[1001]


def test_quality_is_native(small):
    plan = quality.quality_verdicts(small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_keeps_clean_and_drops_junk(spark):
    clean = [(i, passage(i, 100 + i % 300), "en", "s", 1) for i in range(300)]
    junk = [(1000 + i, " ".join(f"{w}%%% &|" for w in passage(i, 200).split()), "en", "s", 1) for i in range(10)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


def test_quality_drops_junk_that_is_much_of_a_group(spark):
    """Junk that varies as the clean rows do, in two fifths of one language and source."""
    rng = random.Random(6)
    spoil = lambda t, p: " ".join(f"{w}%%% &|" if rng.random() < p else w for w in t.split())
    clean = [(i, passage(i, 100 + i % 300), "en", "s", 1) for i in range(300)]
    junk = [(1000 + i, spoil(passage(1000 + i, 200), rng.uniform(0.3, 1.0)), "en", "s", 1) for i in range(200)]
    other = [(2000 + i, passage(2000 + i, 120), "de", "s", 1) for i in range(100)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(clean + junk + other, SCHEMA)).collect()}
    assert sum(got[i] for i, *_ in clean) >= 297 and all(got[i] for i, *_ in other)
    assert sum(got[i] for i, *_ in junk) <= 4


# 7


def test_mixing(edges, small, nothing):
    for df in (edges, small):
        rows = [(r["doc_id"], r["source"], r["text"]) for r in df.select("doc_id", "source", "text").collect()]
        got = [(r["doc_id"], r["source"], r["copy"], r["shuffle_key"], r["text"]) for r in mixing.mix(df).collect()]
        want = [(rows[k][0], rows[k][1], c, key, rows[k][2]) for k, c, key in brute.mixed([(i, s) for i, s, _ in rows])]
        assert by(got) == by(want)
        assert [g[3] for g in got] == sorted(g[3] for g in got)
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(small, weights={"src1": 1.0}).where("source <> 'src1'").count() == 0
    assert mixing.mix(small, weights={}).count() == 0 and mixing.mix(small, weights={}, other_weight=1.0).count() > 0


def test_mixing_with_named_weights(small):
    rows = [(r["doc_id"], r["source"]) for r in small.select("doc_id", "source").collect()]
    got = [(r["doc_id"], r["copy"], r["shuffle_key"]) for r in mixing.mix(small, {"src0": 3.0, "src1": 0.5}, other_weight=1.0).collect()]
    assert by(got) == by((rows[k][0], c, key) for k, c, key in brute.mixed(rows, weights={"src0": 3.0, "src1": 0.5}, other=1.0))


def test_mixing_hits_its_targets(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mix(df, weights={"hot": 0.5, "cold": 0.5}).groupBy("source").count().collect()}
    assert got["hot"] == pytest.approx(20_000, rel=0.03) and got["cold"] == pytest.approx(20_000, rel=0.03)


def test_mixing_hits_its_targets_with_tiny_sources(spark):
    """Rates of about 99 by square roots, and of 5,000 by weights, which takes many draws a row."""
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4, "four").otherwise("hot").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mix(df, temperature=0.5).groupBy("source").count().collect()}
    assert got["four"] == pytest.approx(396, abs=80) and got["hot"] == pytest.approx(39_604, rel=0.03)
    got = {r["source"]: r["count"] for r in mixing.mix(df, weights={"hot": 0.5, "four": 0.5}).groupBy("source").count().collect()}
    assert got["four"] == pytest.approx(20_000, rel=0.03) and got["hot"] == pytest.approx(20_000, rel=0.03)


# 8


def test_winnowing(edges, small, nothing):
    for df in (edges, small):
        rows = pairs(df)
        got = winnow.fingerprint(df)
        assert by((r["doc_id"], list(zip(r["fingerprint"], r["positions"], strict=True))) for r in got.collect()) == by((i, brute.winnowed(t)) for i, t in rows)
    assert winnow.fingerprint(nothing).count() == 0


def test_edited(spark, edges, small, nothing):
    for df, per in ((small, 7), (small, 100_000), (edges, 3)):
        rows = sorted(pairs(df), key=lambda r: (-(1 << 63) if r[0] is None else r[0]))
        got = winnow.with_next(df, "doc_id", "text", per).collect()
        assert len(got) == len(rows)
        if df is small:
            want = {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
            assert {r["_id"]: r["_next"] for r in got} == want
    out = {r["doc_id"]: r for r in winnow.fingerprint_with_edits(small).collect()}
    rows = sorted(pairs(small))
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, new, other = ({h for h, _ in brute.winnowed(x)} for x in (t, edited, following))
        r = out[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == " ".join(f"{(h << 31) + (1 << 31) - 1 - p:X}" for h, p in brute.winnowed(t))
        assert r["near_edited"] == pytest.approx(like(own, new)) and r["near_next"] == pytest.approx(like(own, other))
    assert winnow.fingerprint_with_edits(edges).count() == len(edge_rows())
    assert winnow.fingerprint_with_edits(nothing).count() == 0


def test_edited_fingerprints_come_from_the_parts(spark):
    """Short texts, ties, blanks and nulls: the same values as from going through the whole edited text."""
    rng = random.Random(4)
    sizes = (0, 1, 2, 7, 8, 13, 14, 15, 16, 28, 29, 30, 31, 60, 200)
    texts = ["".join(rng.choice(rng.choice(("ab", "ab \té漢", "a", " \n"))) for _ in range(rng.choice(sizes))) for _ in range(500)]
    rows = [(i, None if i % 29 == 0 else "a" * len(t) if i % 7 == 0 else t) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r["edited_fingerprint"] for r in winnow.fingerprint_with_edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert out[i] == " ".join(f"{(h << 31) + (1 << 31) - 1 - p:X}" for h, p in brute.winnowed(edited))


def test_winnowing_is_native(small):
    plan = winnow.fingerprint_with_edits(small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_match_guarantee():
    """Passages of 15 characters, shifted by any number of characters, with and without spaces."""
    rng = random.Random(9)
    for _ in range(300):
        shared = "".join(rng.choice("abcdefgh é漢") for _ in range(60))
        a, b = ("".join(rng.choice("xyz") for _ in range(rng.randint(0, 40))) + shared + "y" * rng.randint(0, 9) for _ in range(2))
        assert {h for h, _ in brute.winnowed(a)} & {h for h, _ in brute.winnowed(b)}
    run = "".join(rng.choice("abcdefgh") for _ in range(60))
    shifted = {h for h, _ in brute.winnowed("q" + run)}
    assert len({h for h, _ in brute.winnowed(run)} & shifted) >= 8


# 9


def test_automaton():
    rng = random.Random(4)
    lexicon, stems = ["idiot", "moron", "scum", "worthless", "trash"], ["vequ", "lostr"]
    a = toxicity.Automaton(lexicon, stems)
    strings = [*lexicon, *stems, "", "i", "idi0t", "morrron", "scvm", "vequt", "lostrada", "xvequ"]
    for _ in range(6000):
        s = list(rng.choice(lexicon + stems))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(s))
            s[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "o", "é", "t"])
        strings.append("".join(s))
    entry, errors = a.run(strings)
    for s, k, e in zip(strings, entry.tolist(), errors.tolist(), strict=True):
        stem = next((len(lexicon) + j for j, p in enumerate(stems) if s.startswith(p)), -1)
        near = sorted((brute.edit_distance(s, w), j) for j, w in enumerate(lexicon) if brute.edit_distance(s, w) <= (1 if len(w) >= 5 else 0))
        if near and near[0][0] == 0:
            assert (k, e) == (near[0][1], 0), s
        elif stem >= 0:
            assert (k, e) == (stem, 0), s
        else:
            assert (k >= 0) == bool(near) and (not near or e == 1), s


def test_automaton_with_words_under_stems():
    a = toxicity.Automaton(["idiot", "moron"], ["idio", "moron"])
    entry, errors = a.run(["idiot", "idiots", "idio", "id1ot", "idit", "moron", "morons", "mor0n", "mor"])
    assert list(zip(entry.tolist(), errors.tolist(), strict=True)) == [(0, 0), (2, 0), (2, 0), (0, 1), (0, 1), (1, 0), (3, 0), (1, 1), (-1, 0)]


def test_every_word_of_a_large_lexicon_may_have_an_error():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdeéжз") for _ in range(rng.randint(3, 8))) for _ in range(300)}, key=lambda w: rng.random())
    stems = [words[7][:4], "zzzz"]
    strings = [*words, "zzzzz", "", *(w[:k] + rng.choice(["", "q", "a"]) + w[k + 1 :] for w in words for k in (rng.randrange(len(w)),))]
    want = []
    for x in strings:
        hits = [(brute.edit_distance(x, w), k) for k, w in enumerate(words) if abs(len(w) - len(x)) < 2] + [(0, len(words) + k) for k, s in enumerate(stems) if x.startswith(s)]
        e, k = min((h for h in hits if h[0] == 0 or h[0] == 1 and len(words[h[1]]) >= 5), default=(0, -1))
        want.append((k, e))
    for most in (100_000, 500):
        entry, errors = toxicity.Lexicon(words, stems, most).run(strings)
        assert list(zip(entry.tolist(), errors.tolist(), strict=True)) == want
    assert len(toxicity.Lexicon(words, stems, 500).parts) > 5
    entry, errors = toxicity.Automaton(words, stems).run(strings)
    assert list(zip(entry.tolist(), errors.tolist(), strict=True)) == want
    assert toxicity.Lexicon([], []).run(["a", ""])[0].tolist() == [-1, -1]


def test_misspellings_of_learnt_words(spark):
    """A word that a stem covers, and one that has no family, are both found with an error."""
    abuse = ["idiot", "worthless", "moron", "moronic", "morons"]
    rows = [(i, passage(i, 30) + (f" {abuse[i % 5]} {abuse[i // 2 % 5]} " if i % 2 else " ") + passage(1000 + i, 30)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    spelt = ["idiot", "id1ot", "idioot", "idot", "worthles", "worthl3ss", "moron", "mor0n", "moronics"]
    asked = spark.createDataFrame([(k, f"{passage(5000 + k, 30)} {w} {passage(6000 + k, 30)}") for k, w in enumerate([*spelt, "river"])], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(asked, docs, labels).collect()}
    assert [w for k, w in enumerate(spelt) if got[k] < 0.4] == [] and got[len(spelt)] == 0.01


def test_quotation_and_misspelling():
    s = toxicity.Scorer(toxicity.Automaton(["idiot", "moron"], []), np.array([0.99, 0.99]), frozenset(["morn"]))
    score = lambda t: s.score([t.encode()])[0]
    assert score("you are an idiot really") >= 0.7
    assert score("you are an id1ot really") >= 0.7
    assert score("you are an idi-ot really") >= 0.7
    assert score('the post read "you are an idiot really" and more') < 0.7
    assert score("they called him idiot once") < 0.7
    assert score("in the morn we walk") < 0.1
    assert score("") == score("a b c") == 0.01 and s.score([None]) == [0.01]


def test_toxicity(spark, edges, nothing):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learnt = "crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"
    out = toxicity.score_toxicity(docs, docs.where(learnt), labels.where(learnt)).join(labels.where(f"not ({learnt})"), "doc_id").select("toxic", "predicted").collect()
    toxic, clean = [r["predicted"] for r in out if r["toxic"]], [r["predicted"] for r in out if not r["toxic"]]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)
    got = toxicity.score_toxicity(edges, docs.where("doc_id < 2000"), labels)
    assert got.count() == len(edge_rows()) and got.where("score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(nothing, docs, labels.limit(0)).count() == 0


# 10


def test_components_of_documents(edges, small, nothing):
    for df in (edges, small):
        got = jaccard_join.link_documents(df)
        assert by(tuple(r) for r in got.collect()) == brute.components(pairs(df))
    assert jaccard_join.link_documents(nothing).count() == 0


def near_copies():
    """A group whose ends are only linked through others, near misses, and equal sets."""
    rng = random.Random(3)
    start = passage(7, 80).split()
    rows, at = [], list(start)
    for k in range(60):
        rows.append((1000 - k, " ".join(at)))
        at = list(at)
        for _ in range(2):
            at[rng.randrange(80)] = passage(rng.random(), 1)
    rows += [(2000 + k, " ".join(start[: 60 + k % 20] + passage(k, 20).split())) for k in range(60)]
    rows += [(3000 + k, passage(k, 40)) for k in range(30)] + [(4000 + k, rows[5][1].upper()) for k in range(8)]
    return rows


@pytest.mark.parametrize(("sets", "pivots"), [(4000, 64), (60, 24)])
def test_large_regions(spark, sets, pivots):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_join.link_documents(df, max_region_sets=sets, pivots=pivots)
    assert by(tuple(r) for r in got.collect()) == brute.components(rows)


def hot_group(n, seed=4):
    """Copies of one text with few to many edits: most link through some, many with none, and no pivot tells them apart."""
    rng = random.Random(seed)
    start = passage(11, 120).split()
    rows = []
    for k in range(n):
        words = list(start)
        for at in rng.sample(range(120), rng.choice((1, 2, 3, 4, 5))):
            words[at] = rng.choice(start) if rng.random() < 0.3 else passage(rng.random(), 1)
        rows.append((k, " ".join(words)))
    return rows


def test_a_hot_group_takes_one_round(spark, monkeypatch):
    """Rounds that settle a few pivots each would be as many as the group is large."""
    rows = hot_group(300)
    whole, rounds = jaccard_join.components, []
    monkeypatch.setattr(jaccard_join, "components", lambda edges: rounds.append(1) or whole(edges))
    got = jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), max_region_sets=90, pivots=4)
    got = by(tuple(r) for r in got.collect())
    assert len(rounds) <= 4, len(rounds)
    assert got == brute.components(rows)


def test_pipeline_stage_on_a_hot_group(spark, monkeypatch):
    import functools

    import corpus_pipeline

    rows, rounds = hot_group(300), []
    whole, link = jaccard_join.components, jaccard_join.link_documents
    monkeypatch.setattr(jaccard_join, "components", lambda edges: rounds.append(1) or whole(edges))
    monkeypatch.setattr(jaccard_join, "link_documents", functools.partial(link, max_region_sets=90, pivots=4))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert len(rounds) <= 4
    assert got == sorted({x[-1] for x in brute.components(rows)})


def test_tiles_measure_few_pairs():
    sets = [np.unique(grams(word_hashes(t.encode().split()), 5)) for _, t in hot_group(700)]
    want = jaccard_join.Region(sets, 75)
    for i in range(len(sets)):
        want.distances(i, np.arange(i, len(sets)))
    r = jaccard_join.Region(sets, 75)
    r.join(np.arange(len(sets)))
    roots = [want.find(i) for i in range(len(sets))]
    assert [r.find(i) for i in range(len(sets))] == roots and r.measured < len(sets) ** 2 / 10
    # each two blocks on their own, in any order
    parts, split = np.array_split(np.random.default_rng(2).permutation(len(sets)), 4), jaccard_join.Region(sets, 75)
    for i, j in [(3, 0), (1, 1), (2, 3), (0, 0), (1, 0), (3, 3), (2, 1), (0, 2), (2, 2), (1, 3)]:
        split.cross(parts[i], parts[j], 0.25 + 1e-9)
    assert [split.find(i) for i in range(len(sets))] == roots


def test_voronoi_windows_lose_no_link():
    """Whatever the pivots, two linked members meet: one is a pivot, or both go to one region, or both are far."""
    import pyarrow as pa

    sets = {i: np.unique(grams(word_hashes(t.encode().split()), 5)) for i, t in near_copies()}
    nodes = list(sets)
    raw = [sets[i].tobytes() for i in nodes]
    rng = random.Random(8)
    for _ in range(6):
        pivots = rng.sample(range(len(nodes)), 5)
        t = jaccard_join._measure(pa.table({"region": [1] * len(nodes), "node": nodes, "grams": raw}), pa.table({"p_node": [nodes[k] for k in pivots], "p_grams": [raw[k] for k in pivots]}), 75)
        got = {r["node"]: r for r in t.to_pylist()}
        apart = 0
        for a in range(len(nodes)):
            for b in range(a):
                x, y = nodes[a], nodes[b]
                both = len(np.intersect1d(sets[x], sets[y]))
                if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    assert x in got[y]["links"] or y in got[x]["links"] or set(got[x]["goes"]) & set(got[y]["goes"]) or got[x]["far"] and got[y]["far"]
                else:
                    apart += not set(got[x]["goes"]) & set(got[y]["goes"])
        assert apart > 1000


def test_bucket_count():
    from tagloom.llm.common import bucket_count

    assert bucket_count(10) == bucket_count(64 * 8_000_000) == 64
    for gb in (1, 30, 1000, 100_000):  # buckets and messages stay at what a shuffle of that size has
        n = bucket_count(gb * 10**9)
        assert gb * 10**9 / n <= 10.1e6 * gb ** (1 / 3) and n * n <= 1.05e4 * gb ** (4 / 3)


def test_region_recursion():
    rng = np.random.default_rng(5)
    for trial in range(20):
        sets = []
        for _ in range(12):
            core = rng.choice(100_000, rng.integers(5, 60), replace=False).astype(np.uint64)
            for _ in range(int(rng.integers(1, 25))):
                mine = core.copy()
                change = rng.random(len(mine)) < rng.choice([0.02, 0.1, 0.2])
                mine[change] = rng.integers(200_000, 300_000, change.sum())
                sets.append(np.unique(mine))
        r = jaccard_join.Region(sets, 75)
        r.join(np.arange(len(sets)), least=int(rng.choice([4, 16, 48])), pivots=4)
        want = jaccard_join.Region(sets, 75)
        for i in range(len(sets)):
            want.distances(i, np.arange(len(sets)))
        assert [r.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))], trial


def test_links_do_not_depend_on_row_order():
    import pyarrow as pa

    rows = [(i, np.sort(grams(word_hashes(t.encode().split()), 5))) for i, t in near_copies()]
    t = pa.table({"node": [i for i, _ in rows], "grams": [np.unique(g).tobytes() for _, g in rows]})
    want = sorted(zip(*(c.to_pylist() for c in jaccard_join._join_region(t, 75).columns), strict=True))
    for seed in range(4):
        mixed = t.take(np.random.default_rng(seed).permutation(len(rows)))
        got = sorted(zip(*(c.to_pylist() for c in jaccard_join._join_region(mixed, 75).columns), strict=True))
        assert got == want


def test_graph_of_edges_that_change(spark):
    """Edges whose direction differs between evaluations still give whole components."""
    edges = spark.range(2000).select(F.when(F.rand() < 0.5, F.col("id")).otherwise(F.col("id") % 40).alias("a"), F.lit(None).cast("bigint").alias("b"), "id")
    edges = edges.select("a", F.when(F.col("a") == F.col("id"), F.col("id") % 40).otherwise(F.col("id")).alias("b"))
    got = graph.components(edges).collect()
    assert len(got) == 2000 and all(r["component"] == r["node"] % 40 for r in got)


def test_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in got} and len(got) >= len({x for a, b in edges if a is not None and a != b for x in (a, b)})
