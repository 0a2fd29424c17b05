"""DuckDB SQL for the registered queries, written from the semantics and not from the Spark plans."""

from __future__ import annotations

from ..functions import labels as L
from ..functions import text as X
from ..operators import jobs, mixture
from ..operators.tagger import ANY, PATTERNS

SEED = 7
NAMES = [x.replace("_", " ") for x in L.RULE_LABELS]


#: The small vocabulary of the decoding queries: single characters and a few pieces.
VOCAB = [*"abcdefghijklmnopqrstuvwxyz0123456789.<>/ _@ABCDEFGHIJKLMNOPQRSTUVWXYZ", "em", "ema", "<e", "<email>", "</", "</email>", " <", "th", "The", "on", "an", "a ", "an ", "er", "src"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(items: list[str]) -> str:
    return "([" + ", ".join(map(q, items)) + "]::VARCHAR[])"


def draw(seed: int, row: str, purpose: str, *more: str) -> str:
    parts = ", ".join([q(str(seed)), f"({row})::VARCHAR", q(purpose), *[f"({m})::VARCHAR" for m in more]])
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT"


def uniform(seed: int, row: str, purpose: str, *more: str) -> str:
    return f"({draw(seed, row, purpose, *more)} / 4294967296.0)"


def between(seed: int, row: str, purpose: str, low: int, high: str) -> str:
    return f"({low} + floor({uniform(seed, row, purpose)} * (({high}) - {low} + 1)))::INTEGER"


def shuffled(seed: int, row: str, purpose: str, items: str) -> str:
    return f"list_transform(list_sort(list_transform({items}, lambda x: {{'k': {draw(seed, row, purpose, 'x')}, 'x': x}})), lambda z: z.x)"


LABEL = "CASE " + " ".join(f"WHEN regexp_full_match(body, {q(p)}) THEN {q(k)}" for k, p in PATTERNS.items()) + " END"
FOLLOWING = "CASE label " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in zip(L.RULE_LABELS, L.RULE_LABELS[1:] + L.RULE_LABELS[:1], strict=True)) + " END"
#: s: doc_id, lang, source, i, b, e, body, gap, label of every match.
HITS = f"""r AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, {q(ANY)}) AS h, string_split_regex(text, {q(ANY)}) AS g FROM documents),
 x0 AS (SELECT doc_id, lang, source, unnest(h) AS body, unnest(g[1:len(h)]) AS gap, unnest(range(len(h))) AS i FROM r WHERE len(h) > 0),
 x1 AS (SELECT *, CAST(sum(length(gap) + length(body)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM x0),
 s AS (SELECT doc_id, lang, source, i, body, gap, e - length(body) AS b, e, {LABEL} AS label FROM x1)"""
#: p: predicted spans; bad: what is wrong with each row.
EDITS = f"""{HITS},
 p0 AS (SELECT *, {draw(SEED, 'doc_id', 'edit', 'i')} % 20 AS ed FROM s),
 p AS (SELECT doc_id, source, i, b, CASE WHEN ed = 1 THEN e - 1 ELSE e END AS e, CASE WHEN ed = 2 THEN {FOLLOWING} ELSE label END AS label FROM p0 WHERE ed <> 0),
 bad AS (SELECT d.doc_id, d.source, CASE WHEN t = 0 THEN 'copy_drift' WHEN t = 1 AND n.doc_id IS NOT NULL THEN 'malformed' END AS bad
         FROM (SELECT doc_id, source, {draw(SEED, 'doc_id', 'row')} % 20 AS t FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM p) n USING (doc_id))"""
KNOWN = "(" + ", ".join(q(f"src{i}") for i in range(0, 20, 2)) + ")"
CANON = f"source || ':' || CASE WHEN source IN {KNOWN} THEN label ELSE replace(label, '_', ' ') END"
#: ev: tp, fp, fn per row and canonical label, bad rows counted as missed.
EVENTS = f"""{EDITS},
 u AS (SELECT doc_id, source, b, e, label, 1 AS g, 0 AS p FROM s UNION ALL SELECT p.doc_id, p.source, b, e, label, 0, 1 FROM p JOIN bad USING (doc_id) WHERE bad IS NULL),
 ev AS (SELECT doc_id, source, {CANON} AS label, least(sum(g), sum(p)) AS tp, sum(p) - least(sum(g), sum(p)) AS fp, sum(g) - least(sum(g), sum(p)) AS fn FROM u GROUP BY doc_id, source, b, e, label)"""
PRF = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6)::DOUBLE AS p, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6)::DOUBLE AS r,
 round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0.0 END, 6)::DOUBLE AS f1"""
SUMS = "coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn"
#: rel: greedy one-to-one overlap matches; spans of a sound row are in order and of one label at a time, so the
#: recursion walks gold spans and remembers which predictions are taken.
RELAXED = f"""{EDITS},
 lg AS (SELECT doc_id, list({{'b': b, 'e': e, 'l': label}} ORDER BY i) AS g FROM s GROUP BY doc_id),
 lp AS (SELECT doc_id, list({{'b': b, 'e': e, 'l': label}} ORDER BY i) AS p FROM p GROUP BY doc_id),
 rel AS (SELECT d.doc_id, d.source, d.bad, coalesce(len(g), 0) AS n, CASE WHEN d.bad IS NULL THEN coalesce(len(lp.p), 0) ELSE 0 END AS m,
   CASE WHEN d.bad IS NULL AND g IS NOT NULL AND lp.p IS NOT NULL THEN len(list_filter(g, lambda x: len(list_filter(lp.p, lambda y: y.l = x.l AND y.b < x.e AND x.b < y.e)) > 0)) ELSE 0 END AS tp
   FROM bad d LEFT JOIN lg USING (doc_id) LEFT JOIN lp USING (doc_id))"""
TAGGED = f"""{HITS},
 body AS (SELECT doc_id, string_agg(gap || '<' || label || '>' || body || '</' || label || '>', '' ORDER BY i) AS t FROM s GROUP BY doc_id),
 tagged AS (SELECT r.doc_id, coalesce(t, '') || g[len(g)] AS t FROM r LEFT JOIN body USING (doc_id))"""
TEXT_AT = "d.text[{a} + 1:{b}]"

THOUGHTS = """t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '  <think>a' || chr(10) || 'b</think>' || chr(10) || chr(10) || h WHEN 1 THEN 'x' || chr(10) || '<think>a</think> ' || h
 WHEN 2 THEN 'a</think>' || chr(10) || h || '</think>z' ELSE h END AS t FROM (SELECT doc_id, text AS h FROM documents))"""

DATES = arr(L.DATE_FAMILY)
#: sp: the relabelled spans that the mixture queries use.
SPARSE = f"""{HITS},
 sp AS (SELECT doc_id, source, i, b, e, body, CASE WHEN label = 'proper_word' AND i % 2 = 0 THEN {DATES}[(doc_id % 4 + 1)::INTEGER] WHEN label = 'proper_word' THEN 'city' ELSE label END AS label
        FROM s WHERE label <> 'proper_word' OR doc_id % 7 <> 0),
 pres AS (SELECT d.doc_id, d.source, coalesce(l.present, ([]::VARCHAR[])) AS present FROM documents d LEFT JOIN (SELECT doc_id, list_sort(list_distinct(list(label))) AS present FROM sp GROUP BY doc_id) l USING (doc_id))"""


def plan(version: int) -> str:
    seed = mixture.SEED_V1 if version == 1 else mixture.SEED_V2
    vocabulary = arr(L.VOCABULARY)
    kind = f"CASE WHEN {uniform(seed, 'doc_id', 'bucket')} < 0.4 OR len(present) = 0 THEN 'full' WHEN {uniform(seed, 'doc_id', 'bucket')} < 0.8 THEN 'negatives' ELSE 'subset' END"
    rest = f"list_filter({vocabulary}, lambda x: NOT list_contains(present, x))"
    if version == 1:
        pool = f"CASE WHEN list_has_any(present, {DATES}) THEN list_filter({rest}, lambda y: NOT list_contains({DATES}, y)) ELSE {rest} END"
        unit = f"CASE WHEN list_contains({DATES}, y) THEN '#family' ELSE y END"
        negative = f"({shuffled(seed, 'doc_id', 'negative', 'pool')})[1:least({between(seed, 'doc_id', 'negatives', 2, '6')}, len(pool))]"
    else:
        pool, unit = rest, "y"
        fams = " ".join(f"WHEN list_contains({arr(f)}, y) THEN {arr(f)}" for f in L.FAMILIES)
        related = f"list_filter(pool, lambda z: list_contains(flatten(list_transform(present, lambda y: CASE {fams} ELSE ([]::VARCHAR[]) END)), z))"
        pick = f"CASE WHEN len(rel) > 0 AND {uniform(seed, 'doc_id', 'related', 'n')} < 0.5 THEN rel[({draw(seed, 'doc_id', 'negative', 'n')} % greatest(len(rel), 1) + 1)::INTEGER] ELSE pool[({draw(seed, 'doc_id', 'negative', 'n')} % greatest(len(pool), 1) + 1)::INTEGER] END"
        negative = f"list_distinct(list_transform(range(1, least({between(seed, 'doc_id', 'negatives', 2, '6')}, len(pool)) + 1), lambda n: {pick}))"
    units = f"list_distinct(list_transform(present, lambda y: {unit}))"
    related_col = f", {related} AS rel" if version == 2 else ""
    # draws are keyed by the unit itself, so the order in which duplicates are dropped does not matter
    return f"""{SPARSE},
 k0 AS (SELECT doc_id, source, present, {kind} AS bucket, {pool} AS pool, {units} AS units FROM pres),
 k1 AS (SELECT *{related_col} FROM k0),
 k2 AS (SELECT *, {negative} AS neg, ({shuffled(seed, 'doc_id', 'drop', 'units')})[1:{between(seed, 'doc_id', 'drops', 1, 'len(units) - 1')}] AS gone FROM k1),
 k3 AS (SELECT *, CASE WHEN bucket <> 'subset' OR len(units) < 2 THEN present ELSE list_filter(present, lambda y: NOT list_contains(gone, {unit})) END AS target FROM k2),
 k AS (SELECT doc_id, source, bucket, present, target, CASE bucket WHEN 'full' THEN {vocabulary} WHEN 'negatives' THEN {shuffled(seed, 'doc_id', 'request', 'list_concat(present, neg)')} ELSE target END AS request FROM k3)"""


def picked(seed: int, row: str, request: str, text: str) -> str:
    """Aliases of request, ? where none is left; no alias belongs to two labels of the default map, so picks are independent."""
    table = "map {" + ", ".join(f"{q(s)}: {arr(a)}" for s, a in L.ALIASES.items()) + "}"
    free = f"list_filter(({table})[x], lambda a: NOT contains({text}, '<' || a || '>') AND NOT contains({text}, '</' || a || '>'))"
    return f"list_transform({request}, lambda x: coalesce(({free})[({draw(seed, row, 'alias', 'x')} % greatest(len({free}), 1) + 1)::INTEGER], '?'))"


def _mixture(version: int) -> str:
    """CTEs up to w (kept rows, negative flags), tg (tagged bodies) and n (names of each request)."""
    seed, cap = (mixture.SEED_V1, 0.1) if version == 1 else (mixture.SEED_V2, 0.08)
    birth = "k.bucket = 'subset' AND list_contains(present, 'date_of_birth') AND NOT list_contains(target, 'date_of_birth') AND list_contains(target, 'date')" if version == 2 else "FALSE"
    rules = " ".join(f"WHEN {q(label)} THEN {q(rule)}" for label, rule in L.RULES.items())
    guided = f"list_transform(names, lambda y, i: CASE WHEN {uniform(seed, 'doc_id', 'guided')} < 0.3 THEN y || coalesce(': ' || CASE request[i] {rules} END, '') ELSE y END)"
    lines = guided if version == 2 else "names"
    keep = f"NOT negative OR w.k + 1 <= greatest(20, {cap} * (w.emitted + 1))"
    return f"""WITH RECURSIVE {plan(version)},
 n0 AS (SELECT k.doc_id, k.source, d.text, request, target, {birth} AS birth, {picked(seed, 'k.doc_id', 'request', 'd.text')} AS names FROM k JOIN documents d USING (doc_id)),
 n AS (SELECT *, {lines} AS lines FROM n0),
 neg AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS o, len(target) = 0 AS negative FROM n),
 w AS (SELECT source, o, doc_id, negative, negative::INTEGER AS k, TRUE AS kept, 1 AS emitted FROM neg WHERE o = 1
       UNION ALL SELECT neg.source, neg.o, neg.doc_id, neg.negative, w.k + neg.negative::INTEGER, {keep.replace('negative', 'neg.negative')}, w.emitted + ({keep.replace('negative', 'neg.negative')})::INTEGER
       FROM w JOIN neg ON neg.source = w.source AND neg.o = w.o + 1),
 rl AS (SELECT sp.doc_id, sp.b, sp.e, CASE WHEN n.birth AND sp.label = 'date_of_birth' THEN 'date' ELSE sp.label END AS label, n.request, n.names, n.target FROM sp JOIN n USING (doc_id)),
 sl AS (SELECT doc_id, b, e, names[list_position(request, label)] AS name FROM rl WHERE list_contains(target, label)),
 pc AS (SELECT sl.doc_id, b, d.text[lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) + 1:b] || '<' || name || '>' || d.text[b + 1:e] || '</' || name || '>' AS piece, e FROM sl JOIN documents d USING (doc_id)),
 tg AS (SELECT doc_id, string_agg(piece, '' ORDER BY b) AS t, max(e) AS last FROM pc GROUP BY doc_id)"""


def _examples(version: int) -> str:
    """Rendered examples; texts of the driver tables hold no tags and their spans do not overlap, so only the cap drops rows."""
    seed = mixture.SEED_V1 if version == 1 else mixture.SEED_V2
    return f"""{_mixture(version)}
 SELECT n.doc_id AS row_id, n.source, md5({q(X.REQUEST_HEAD)} || array_to_string(list_transform({shuffled(seed, 'n.doc_id', 'line', 'lines')}, lambda y: '- ' || y), chr(10)) || {q(X.REQUEST_TEXT)} || text) AS user_md5,
        md5(coalesce(t, '') || substr(text, coalesce(last, 0) + 1)) AS assistant_md5
 FROM n JOIN w USING (doc_id) LEFT JOIN tg USING (doc_id) WHERE kept"""


def _synthesis(families: list[tuple[str, str, int, str]], seed: int = 20260718) -> str:
    rows = " UNION ALL ".join(f"SELECT {q(tag)} AS tag, {q(model)} AS model, {q(brief)} AS brief, i FROM range({count}) t(i)" for tag, model, count, brief in families)
    picked_labels = f"({shuffled(seed, 'key', 'label', arr(L.VOCABULARY))})[1:{between(seed, 'key', 'labels', 4, '8')}]"
    return f"""WITH f AS ({rows}), g AS (SELECT *, tag || '-' || i AS key FROM f)
        SELECT printf('D-%s-%04d', tag, i) AS custom_id, model, md5(brief || 'Wrap every entity matching these types in XML tags using exactly these tag names: ' || array_to_string(list_transform({picked_labels}, lambda y: replace(y, '_', ' ')), ', ')
               || '. ' || {q(jobs.SYNTHESIS_RULES)} || 'Seed: ' || ({draw(seed, 'key', 'seed')} % 1000000001)) AS user_md5 FROM g"""


def _plan_query(version: int) -> str:
    birth = "(bucket = 'subset' AND list_contains(present, 'date_of_birth') AND NOT list_contains(target, 'date_of_birth') AND list_contains(target, 'date'))" if version == 2 else "FALSE"
    j = lambda c: f"array_to_string({c}, ',') AS {c}"
    request = "request"
    return f"WITH {plan(version)} SELECT doc_id AS row_id, bucket, {j('present')}, {j(request)}, {j('target')}, {birth} AS relabel_birth FROM k"


def _user_a(text: str = "text") -> str:
    return f"'Requested labels: {', '.join(NAMES)}' || chr(10) || chr(10) || 'Document:' || chr(10) || {text} || chr(10) || chr(10) || 'Gold spans:' || chr(10) || '[' || coalesce(gl, '') || ']'"


ADJ = f"""{HITS},
 gj AS (SELECT doc_id, string_agg('{{"i": ' || i || ', "text": ' || to_json(body) || ', "label": "' || label || '"}}', ', ' ORDER BY i) AS gl FROM s GROUP BY doc_id),
 adj AS (SELECT d.doc_id AS row_id, {_user_a('d.text')} AS u FROM documents d LEFT JOIN gj USING (doc_id))"""

VOCAB_ROWS = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(VOCAB))
#: st: the automaton after half of each text and, by row number, nothing, a tag, the beginning of one, all in a tag, or a stray mark.
STATES = """h0 AS (SELECT doc_id, doc_id % 5 AS k, text AS src, substr(text, 1, length(text) // 2) AS h FROM documents),
 h1 AS (SELECT *, substr(src, length(h) + 1, 3) AS nx FROM h0),
 h2 AS (SELECT *, CASE WHEN k = 2 THEN CASE WHEN nx = '<na' THEN 3 WHEN substr(nx, 1, 2) = '<n' THEN 2 WHEN substr(nx, 1, 1) = '<' THEN 1 ELSE 0 END WHEN k = 4 AND substr(nx, 1, 1) = '#' THEN 1 ELSE 0 END AS more FROM h1),
 st AS (SELECT doc_id, src, CASE WHEN k = 3 THEN length(src) ELSE length(h) + more END AS copy_pos, CASE WHEN k = 1 THEN 'email' END AS open_tag, CASE WHEN k = 1 THEN length(h) ELSE 0 END AS open_pos,
   CASE WHEN k = 2 AND more = 0 THEN '<na' ELSE '' END AS pending, CASE k WHEN 2 THEN more IN (0, 3) WHEN 4 THEN more = 1 ELSE TRUE END AS valid FROM h2)"""
PRICES = {"large": (2.0, 8.0), "small": (0.4, 1.6), "nano": (0.1, 0.4)}


def price(model: str, chars: str = "chars") -> str:
    read, written = PRICES[model]
    return f"({chars} / 4 / 1e6 * {read} + 350 / 1e6 * {written})"


#: cost of every job-A request: the length of its messages as JSON escaped to ASCII, in which a mark takes two characters, a control or
#: other character six, and one beyond the basic plane twelve.
COST = f"""{ADJ},
 ln AS (SELECT row_id, length(u) + length(regexp_replace(u, '[^"\\\\\\n\\r\\t\\f\\x08]', '', 'g')) + 5 * length(regexp_replace(u, '[\\x20-\\x7E\\n\\r\\t\\f\\x08]', '', 'g'))
          + 6 * length(regexp_replace(u, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')) + length('[{{"role": "system", "content": "You audit span annotations."}}, {{"role": "user", "content": ""}}]') AS chars FROM adj),
 cost AS (SELECT row_id, chars, {price('large')} AS cost FROM ln)"""

ORACLES = {
    "lang_slice": "SELECT doc_id, source FROM documents WHERE lang = 'en'",
    "first_n_scan": "SELECT doc_id AS row_id, lang FROM documents WHERE doc_id < 100",
    "upsample_union": """SELECT 'documents' AS source, 0 AS repeat, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents
        UNION ALL SELECT 'benchmark', repeat::INTEGER, count(*), sum(length(text))::BIGINT FROM benchmark, range(3) t(repeat) GROUP BY repeat""",
    "hash_sample_cap": f"SELECT doc_id AS row_id, source FROM documents ORDER BY {draw(mixture.SEED_V2 + 1, 'doc_id', 'cap')}, doc_id LIMIT 150",
    "spans_found": f"WITH {HITS} SELECT doc_id AS row_id, i::INTEGER AS i, b::INTEGER AS b, e::INTEGER AS e, label FROM s",
    "inject_tagged": f"WITH {TAGGED} SELECT doc_id AS row_id, length(t)::BIGINT AS n_chars, md5(t) AS tagged_md5 FROM tagged",
    "parse_roundtrip": f"WITH {HITS} SELECT d.doc_id AS row_id, coalesce(n, 0)::BIGINT AS n_spans, TRUE AS same_text, TRUE AS same_spans FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) USING (doc_id)",
    "parse_faults": f"WITH {EDITS} SELECT source, CASE WHEN bad = 'malformed' THEN 'unclosed tag' ELSE 'sound' END AS reason, count(*) AS n FROM bad GROUP BY ALL",
    "overlap_reject": f"""WITH {HITS}, l AS (SELECT s.doc_id, s.source, s.i, s.b, CASE WHEN {draw(SEED, 's.doc_id', 'long', 's.i')} % 50 = 0 THEN least(s.e + 30, length(d.text)) ELSE s.e END AS e FROM s JOIN documents d USING (doc_id)),
        o AS (SELECT doc_id, bool_or(b < pe) AS bad FROM (SELECT doc_id, b, lag(e) OVER (PARTITION BY doc_id ORDER BY b, e) AS pe FROM l) GROUP BY doc_id)
        SELECT source, CASE WHEN coalesce(bad, FALSE) THEN 'Overlapping spans' ELSE 'kept' END AS reason, coalesce(bad, FALSE) AS native, count(*) AS n FROM documents LEFT JOIN o USING (doc_id) GROUP BY ALL""",
    "min_len_filter": f"WITH {HITS} SELECT label, count(*) AS n FROM s WHERE label IN ('email', 'proper_word') AND e - b >= 5 GROUP BY label",
    "present_labels": f"WITH {HITS} SELECT d.doc_id AS row_id, coalesce(l, '') AS labels FROM documents d LEFT JOIN (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS l FROM s GROUP BY doc_id) USING (doc_id)",
    "faithfulness": f"WITH {EDITS} SELECT doc_id AS row_id, coalesce(bad, '') <> 'copy_drift' AS faithful FROM bad",
    "context_snippets": f"WITH {HITS} SELECT s.doc_id AS row_id, i::INTEGER AS i, d.text[greatest(b - 45, 0) + 1:e + 15] AS snippet FROM s JOIN documents d USING (doc_id) WHERE label <> 'proper_word'",
    "offset_validation": f"""WITH {HITS}, v AS (SELECT doc_id, bool_and({draw(SEED, 'doc_id', 'value', 'i')} % 100 <> 0) AS ok FROM s GROUP BY doc_id)
        SELECT doc_id::VARCHAR AS uid, coalesce(ok, FALSE) AS valid FROM documents LEFT JOIN v USING (doc_id) WHERE lang = 'en'""",
    "conversion_counters": f"""WITH {HITS}, v AS (SELECT doc_id, bool_or({draw(SEED, 'doc_id', 'value', 'i')} % 100 = 0) AS bad FROM s WHERE lang = 'en' GROUP BY doc_id)
        SELECT count(*) FILTER (WHERE NOT bad) AS kept, count(*) FILTER (WHERE bad) AS bad_offsets, 0::BIGINT AS one_char_spans FROM v""",
    "label_frequency": f"""WITH {HITS}, v AS (SELECT doc_id, i, label, sum(CASE WHEN {draw(SEED, 'doc_id', 'value', 'i')} % 100 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS bad FROM s WHERE lang = 'en')
        SELECT label, count(*) AS n FROM v WHERE bad = 0 GROUP BY label""",
    "skip_reasons": f"""WITH {HITS}, l AS (SELECT s.doc_id, s.i, s.b, {draw(SEED, 's.doc_id', 'value', 's.i')} % 100 = 0 AS wrong, CASE WHEN {draw(SEED, 's.doc_id', 'long', 's.i')} % 50 = 0 THEN least(s.e + 30, length(d.text)) ELSE s.e END AS e FROM s JOIN documents d USING (doc_id)),
        o AS (SELECT doc_id, bool_or(wrong) AS wrong, bool_or(b < pe) AS over FROM (SELECT doc_id, wrong, b, lag(e) OVER (PARTITION BY doc_id ORDER BY b, e) AS pe FROM l) GROUP BY doc_id)
        SELECT reason, count(*) AS n FROM (SELECT CASE WHEN wrong THEN 'Offset mismatch' WHEN over THEN 'Overlapping spans' END AS reason FROM o) WHERE reason IS NOT NULL GROUP BY reason""",
    "date_repair": "SELECT CASE WHEN event_id % 2 = 0 THEN 'date_time' ELSE 'date' END AS label, count(*) AS n FROM events GROUP BY 1",
    "canonical_labels": f"WITH {HITS} SELECT {CANON} AS label, count(*) AS n FROM s GROUP BY 1",
    "positional_join": f"""WITH {EDITS}, c AS (SELECT doc_id, bool_or(ed <= 2) AS edited FROM p0 GROUP BY doc_id)
        SELECT source, count(*) AS n, count(*) FILTER (WHERE bad IS NULL AND NOT coalesce(edited, FALSE)) AS same FROM bad LEFT JOIN c USING (doc_id) GROUP BY source""",
    "exact_match_counts": f"WITH {EVENTS} SELECT doc_id AS row_id, {SUMS} FROM ev GROUP BY doc_id",
    "relaxed_match_counts": f"WITH {RELAXED} SELECT doc_id AS row_id, tp::BIGINT AS tp, (m - tp)::BIGINT AS fp, (n - tp)::BIGINT AS fn FROM rel",
    "ops_counters": f"WITH {EDITS} SELECT count(*) AS rows, count(*) FILTER (WHERE bad = 'malformed') AS malformed, count(*) FILTER (WHERE bad = 'copy_drift') AS copy_drift, 0::BIGINT AS unrequested_tags FROM bad",
    "micro_prf": f"""WITH {RELAXED[: RELAXED.index(EDITS)]}{EVENTS}{RELAXED[len(EDITS):]},
        a AS (SELECT 'strict_exact' AS tally, {SUMS} FROM ev UNION ALL SELECT 'parseable_exact', {SUMS} FROM ev JOIN bad USING (doc_id) WHERE bad IS NULL
              UNION ALL SELECT 'strict_relaxed', sum(tp)::BIGINT, sum(m - tp)::BIGINT, sum(n - tp)::BIGINT FROM rel UNION ALL SELECT 'parseable_relaxed', sum(tp)::BIGINT, sum(m - tp)::BIGINT, sum(n - tp)::BIGINT FROM rel WHERE bad IS NULL)
        SELECT tally, tp, fp, fn, {PRF} FROM a""",
    "prf_by_label": f"WITH {EVENTS}, a AS (SELECT label, {SUMS} FROM ev GROUP BY label) SELECT label, tp + fn AS support, tp, fp, fn, {PRF} FROM a",
    "prf_by_source": f"""WITH {EVENTS}, a AS (SELECT b.source, rows, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (SELECT source, count(*) AS rows FROM bad GROUP BY source) b LEFT JOIN (SELECT source, {SUMS} FROM ev GROUP BY source) USING (source))
        SELECT source, rows, tp, fp, fn, {PRF} FROM a""",
    "scorer_self_test": "SELECT count(*) AS rows, TRUE AS ok FROM documents",
    "autopsy_counts": f"""WITH {EDITS}, live AS (SELECT doc_id FROM bad WHERE coalesce(bad, '') <> 'malformed'),
        gs AS (SELECT s.* FROM s JOIN live USING (doc_id)), ps AS (SELECT p.* FROM p JOIN live USING (doc_id)),
        ge AS (SELECT g.doc_id, {CANON.replace('source', 'g.source').replace('label', 'g.label')} AS label, CASE WHEN bool_or(p.label = g.label AND p.b = g.b AND p.e = g.e) THEN 'exact' WHEN bool_or(p.label = g.label) THEN 'boundary' WHEN count(p.label) > 0 THEN 'label_swap' ELSE 'miss' END AS kind
               FROM gs g LEFT JOIN ps p ON p.doc_id = g.doc_id AND p.b < g.e AND g.b < p.e GROUP BY g.doc_id, g.source, g.i, g.label),
        pe AS (SELECT {CANON.replace('source', 'p.source').replace('label', 'p.label')} AS label FROM ps p WHERE NOT EXISTS (SELECT 1 FROM gs g WHERE g.doc_id = p.doc_id AND g.label = p.label AND p.b < g.e AND g.b < p.e)),
        a AS (SELECT label, kind FROM ge UNION ALL SELECT label, 'spurious' FROM pe)
        SELECT label, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ('exact', 'boundary', 'miss', 'label_swap', 'spurious'))} FROM a GROUP BY label""",
    "reward_scores": f"""WITH {RELAXED}, z AS (SELECT *, CASE WHEN m > 0 THEN tp / m WHEN n = 0 THEN 1.0 ELSE 0.0 END AS pr, CASE WHEN n > 0 THEN tp / n ELSE 1.0 END AS rc FROM rel),
        lost AS (SELECT rel.doc_id, len(lp.p) AS np, tl FROM rel JOIN lp USING (doc_id) JOIN (SELECT doc_id, len(list_filter(g, lambda x: len(list_filter(lp.p[1:len(lp.p) - 1], lambda y: y.l = x.l AND y.b < x.e AND x.b < y.e)) > 0)) AS tl FROM lg JOIN lp USING (doc_id)) USING (doc_id)),
        y AS (SELECT z.doc_id, z.bad, n, pr, rc, np, tl FROM z LEFT JOIN lost USING (doc_id))
        SELECT doc_id AS row_id, round(CASE WHEN bad = 'copy_drift' THEN 0.0 WHEN bad = 'malformed' THEN CASE WHEN coalesce(tl, 0) = 0 THEN CASE WHEN n = 0 AND np = 1 THEN 1.0 ELSE 0.0 END ELSE 2 * (tl / (np - 1)) * (tl / n) / (tl / (np - 1) + tl / n) END
               WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6)::DOUBLE AS reward FROM y""",
    "think_strip_a": rf"WITH {THOUGHTS} SELECT doc_id, length(a)::BIGINT AS n_chars, md5(a) AS answer_md5 FROM (SELECT doc_id, regexp_replace(t, '(?m)^\s*<think>(?s:.*?)</think>\s*', '') AS a FROM t)",
    "think_strip_b": rf"WITH {THOUGHTS} SELECT doc_id, length(a)::BIGINT AS n_chars, md5(a) AS answer_md5 FROM (SELECT doc_id, regexp_replace(t, '(?s)\A\s*<think>.*?</think>\s*', '') AS a FROM t)",
    "think_strip_c": rf"WITH {THOUGHTS} SELECT doc_id, length(a)::BIGINT AS n_chars, md5(a) AS answer_md5 FROM (SELECT doc_id, regexp_replace(t, '(?s)\A.*?</think>\s*', '') AS a FROM t)",
    "think_gate": f"""WITH {THOUGHTS}, g AS (SELECT doc_id, t, CASE WHEN contains(t, '</think>') THEN ltrim(substr(t, strpos(t, '</think>') + 8), chr(10)) END AS a FROM t)
        SELECT doc_id, CASE WHEN contains(t, '</think>') THEN 'answer' WHEN length(t) >= 600 THEN 'close' ELSE 'free' END AS phase, length(a)::BIGINT AS n_chars, md5(a) AS answer_md5 FROM g""",
    "names_normalise": "SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS names FROM (SELECT doc_id, [lang, source, 'e-mail'] AS list_distinct_ordered FROM documents)",
    "request_roundtrip": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || chr(10) || chr(10) || 'Text:' || chr(10) || lang ELSE source END AS t, 'email|phone number' AS names FROM documents",
    "output_budgets": "SELECT doc_id, least(16000, floor(n_chars / 2.5) + 1500)::BIGINT AS baseline, least(6144, n_chars + 512)::BIGINT AS evaluate, least(6144, n_chars + 256)::BIGINT AS serve, least(floor(n_chars / 2) + 512, 4096)::BIGINT AS generate FROM documents",
    "chat_triples": "SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id",
    "request_plan_v1": _plan_query(1),
    "request_plan_v2": _plan_query(2),
    "alias_pick": f"WITH d AS (SELECT page_id AS row_id, CASE WHEN page_id % 2 = 0 THEN '<any url></time mention>' || html ELSE html END AS text FROM pages) SELECT row_id, array_to_string({picked(mixture.SEED_V1, 'row_id', arr(L.VOCABULARY), 'text')}, ',') AS names FROM d",
    "negative_cap": f"""WITH RECURSIVE {SPARSE}, neg AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS o, len(present) = 0 AS negative, doc_id % 11 <> 0 AS emits FROM pres),
        w AS (SELECT source, o, doc_id, negative::INTEGER AS k, TRUE AS kept, emits::INTEGER AS emitted FROM neg WHERE o = 1
              UNION ALL SELECT neg.source, neg.o, neg.doc_id, w.k + negative::INTEGER, NOT negative OR w.k + 1 <= greatest(5, 0.1 * (w.emitted + 1)),
              w.emitted + (emits AND (NOT negative OR w.k + 1 <= greatest(5, 0.1 * (w.emitted + 1))))::INTEGER FROM w JOIN neg ON neg.source = w.source AND neg.o = w.o + 1)
        SELECT doc_id AS row_id, kept FROM w""",
    "mixture_v1": _examples(1),
    "mixture_v2": _examples(2),
    "mixture_stats": f"""{_mixture(1)} SELECT source, count(*) FILTER (WHERE kept) AS rows, 0::BIGINT AS skip_overlap, 0::BIGINT AS skip_alias, count(*) FILTER (WHERE negative) AS neg_rows,
        count(*) FILTER (WHERE NOT kept) AS neg_dropped, 0::BIGINT AS relabeled_subset FROM w GROUP BY source""",
    "emitted_limit": f"{_mixture(1)} SELECT doc_id AS row_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM w WHERE kept) WHERE n <= 3",
    "containment_negatives": f"""WITH {SPARSE}, ch AS (SELECT * FROM (VALUES {', '.join(f"({k}, {arr(c)})" for k, c in enumerate(L.CHAINS))}) t(chain, labels)),
        pos AS (SELECT chain, unnest(labels) AS label, unnest(range(len(labels))) AS j FROM ch), hold AS (SELECT doc_id, chain, label, j, list_contains(present, label) AS held FROM pres, pos),
        edge AS (SELECT a.doc_id, a.chain, list(a.label ORDER BY a.j) AS el FROM hold a WHERE NOT a.held AND EXISTS (SELECT 1 FROM hold b WHERE b.doc_id = a.doc_id AND b.chain = a.chain AND b.held AND abs(b.j - a.j) = 1) GROUP BY ALL),
        ask AS (SELECT doc_id, chain, el[({draw(mixture.SEED_V2, 'doc_id', 'edge', 'chain')} % len(el) + 1)::INTEGER] AS asked FROM edge)
        SELECT doc_id AS row_id, chain::INTEGER AS chain, asked, md5({q(X.REQUEST_HEAD)} || '- ' || replace(asked, '_', ' ') || {q(X.REQUEST_TEXT)} || text) AS user_md5 FROM ask JOIN documents USING (doc_id)""",
    "probe_axes": f"""WITH {EVENTS}, ax AS (SELECT b.doc_id, bad, s.doc_id IS NULL AS absent, CASE WHEN b.doc_id % 10 <> 0 THEN 'axis' || (b.doc_id % 3) END AS axis FROM bad b LEFT JOIN (SELECT DISTINCT doc_id FROM s) s USING (doc_id)),
        a AS (SELECT axis, {SUMS} FROM ax JOIN ev USING (doc_id) GROUP BY axis), b AS (SELECT axis, count(*) AS rows, count(bad) AS bad, count(*) FILTER (WHERE absent) AS absent, count(*) FILTER (WHERE absent AND bad IS NULL) AS abstained FROM ax GROUP BY axis)
        SELECT b.axis, rows, bad, absent, abstained, tp, fp, fn, {PRF} FROM b JOIN a ON a.axis IS NOT DISTINCT FROM b.axis""",
    "job_audit": f"""WITH {SPARSE}, pc AS (SELECT sp.doc_id, b, d.text[lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) + 1:b] || '<' || label || '>' || sp.body || '</' || label || '>' AS piece, e FROM sp JOIN documents d USING (doc_id)),
        tg AS (SELECT doc_id, string_agg(piece, '' ORDER BY b) AS t, max(e) AS last FROM pc GROUP BY doc_id),
        tx AS (SELECT d.doc_id, coalesce(t, '') || substr(text, coalesce(last, 0) + 1) AS t FROM documents d LEFT JOIN tg USING (doc_id)),
        o AS (SELECT doc_id, t, row_number() OVER (ORDER BY {draw(20260718, 'doc_id', 'audit')}, doc_id) - 1 AS n FROM tx WHERE regexp_matches(t, {q(jobs.AUDIT_TARGETS)}) AND length(t) <= {jobs.AUDIT_CHARS})
        SELECT doc_id AS row_id, printf('B-%05d', n) AS custom_id, md5(t) AS user_md5 FROM o WHERE n < {jobs.AUDIT_ROWS}""",
    "job_synthesis": _synthesis([("dlog", "nano", 110, "Write a log. "), ("form", "small", 70, "Write a form. "), ("prose", "small", 70, "Write prose. ")]),
    "automaton_state": f"WITH {STATES} SELECT doc_id AS row_id, copy_pos::INTEGER AS copy_pos, open_tag, open_pos::INTEGER AS open_pos, pending, valid FROM st",
    "allowed_tokens": f"""WITH {STATES}, v AS (SELECT * FROM (VALUES {VOCAB_ROWS}) t(id, token)),
        x AS (SELECT doc_id, substr(src, copy_pos + 1) AS rest, length(src) - copy_pos AS room, open_tag, copy_pos - open_pos AS inside, pending, valid FROM st),
        texts AS (
          SELECT doc_id, rest AS t FROM x WHERE valid AND pending = '' AND room > 0
          UNION ALL SELECT doc_id, substr(rest, 1, j) || tag || substr(rest, j + 1) FROM x, (VALUES ('<email>'), ('<name>')) g(tag), range(8) r(j) WHERE valid AND pending = '' AND open_tag IS NULL AND room - j >= 2
          UNION ALL SELECT doc_id, substr(rest, 1, j) || '</' || open_tag || '>' || substr(rest, j + 1) FROM x, range(9) r(j) WHERE valid AND pending = '' AND open_tag IS NOT NULL AND j <= room AND inside + j >= 2
          UNION ALL SELECT doc_id, 'me>' || rest FROM x WHERE valid AND pending = '<na' AND room >= 2),
        f AS (SELECT DISTINCT doc_id, id FROM texts JOIN v ON starts_with(t, token)),
        e AS (SELECT doc_id, 1000 AS id FROM x WHERE NOT valid OR (pending = '' AND open_tag IS NULL AND room = 0) OR doc_id NOT IN (SELECT doc_id FROM f)),
        a AS (SELECT * FROM f UNION SELECT * FROM e)
        SELECT doc_id AS row_id, count(*) AS n, sum(id)::BIGINT AS ids FROM a GROUP BY doc_id""",
    "job_cost": f"WITH {COST} SELECT row_id, round(cost, 9) AS cost FROM cost",
    "job_cost_by_model": f"""WITH {COST}, m AS (SELECT CASE WHEN row_id % 2 = 0 THEN 'nano' ELSE 'small' END AS model, CASE WHEN row_id % 2 = 0 THEN {price('nano')} ELSE {price('small')} END AS cost FROM cost)
        SELECT model, count(*) AS n, round(sum(cost), 6) AS cost FROM m GROUP BY ROLLUP (model)""",
    "job_trim": f"""WITH RECURSIVE {COST}, c AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS rn, sum(cost) OVER (ORDER BY row_id) AS cum FROM cost),
        whole AS (SELECT sum(cost) / 3 AS budget, count(*) AS n, sum(cost) AS cost FROM cost),
        t AS (SELECT 0 AS turn, n, cost, budget FROM whole UNION ALL
              SELECT turn + 1, floor(t.n * t.budget / t.cost * 0.97)::BIGINT, (SELECT coalesce(max(cum), 0) FROM c WHERE rn <= floor(t.n * t.budget / t.cost * 0.97)), t.budget FROM t WHERE t.cost > t.budget AND t.n > 10)
        SELECT row_id FROM c WHERE rn <= (SELECT arg_max(n, turn) FROM t)""",
    "job_trim_mixed": f"""WITH RECURSIVE {COST}, c AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS n, cost FROM cost), whole AS (SELECT sum(cost) * 0.75 AS budget FROM cost),
        t AS (SELECT 0 AS turn, row_id, n, cost, sum(cost) OVER () AS total FROM c UNION ALL
              SELECT turn + 1, row_id, n - n // 10 - 1, cost, sum(cost) OVER () FROM (SELECT t.* FROM t, whole WHERE total > budget AND n % 10 <> 0))
        SELECT row_id FROM t WHERE turn = (SELECT max(turn) FROM t)""",
    "prefix_tokens": "WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(t)})" for i, t in enumerate(VOCAB)) + ") t(id, token)) SELECT doc_id, count(*) AS n, sum(id)::BIGINT AS ids FROM documents JOIN v ON starts_with(text, token) GROUP BY doc_id",
    "tag_requests": f"""WITH {HITS}, x AS (SELECT doc_id, sum(2 * length(label) + 5) AS more FROM s WHERE label IN ('email', 'phone_number') GROUP BY doc_id)
        SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'need text and at least one entity type' END AS error, 'email,phone number' AS names, CASE WHEN doc_id % 10 <> 0 THEN TRUE END AS faithful,
               CASE WHEN doc_id % 10 <> 0 THEN length(text) + coalesce(more, 0) END::BIGINT AS n_chars FROM documents LEFT JOIN x USING (doc_id)""",
    "literal_spans": f"WITH {HITS} SELECT d.doc_id AS row_id, coalesce(n, 0)::BIGINT AS n_spans, TRUE AS same FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) USING (doc_id)",
    "job_adjudicate": f"WITH {ADJ} SELECT row_id, printf('A-%03d', row_id) AS custom_id, 'large' AS model, 700::INTEGER AS max_tokens, md5(u) AS user_md5 FROM adj WHERE row_id < {jobs.ADJUDICATED}",
    "job_aliases": "SELECT * FROM (VALUES " + ", ".join(f"({q('C-default-' + s)}, 'Entity type: ' || {q(s)} || chr(10) || 'Existing names: [' || {q(', '.join(chr(39) + a + chr(39) for a in forms))} || ']' || chr(10) || 'Description context: PII detection.')" for s, forms in L.ALIASES.items()) + ') t(custom_id, "user")',
    "usage_totals": "SELECT 'm' || (doc_id % 3) AS model, count(*) AS n, count(*) FILTER (WHERE doc_id % 17 = 0) AS failures, sum(n_chars) FILTER (WHERE doc_id % 17 <> 0)::BIGINT AS prompt_tokens, sum(n_chars % 97) FILTER (WHERE doc_id % 17 <> 0)::BIGINT AS completion_tokens FROM documents GROUP BY 1",
    "corrected_gold": f"""WITH {HITS}, v AS (SELECT *, {draw(SEED, 'doc_id', 'verdict', 'i')} % 35 AS t FROM s)
        SELECT CASE WHEN t % 7 = 0 THEN 'fixed' ELSE label END AS label, count(*) AS n, sum(e - b)::BIGINT AS chars FROM v WHERE t % 5 <> 0 GROUP BY 1""",
}
