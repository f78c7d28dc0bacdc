"""SQL of the queries over sequences: markup, labels, alignments, matches in order. Steps that depend on the step before
are recursive: every sequence takes one step a round."""

from __future__ import annotations

from speechloom.plans.interval_queries import WORDS

_EDGE = r"""[\s\x{3000}\x{3001}\x{3002}\x{ff0c}\x{ff0e}\x{ff01}\x{ff1f}\x{300c}-\x{300f}\x{3008}\x{3009}\x{ff08}\x{ff09}.,!?\-"''()\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}]+"""
_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _normal(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{_WS}', ' ', 'g')))"


def _token_ja(c: str) -> str:
    return f"regexp_replace({c}, '^{_EDGE}|{_EDGE}$', '', 'g')"


# Markup: one state per sentence, the stacks of open braces (letters) and repairs (1 before the plus) as strings.
_MARKUP = r"""
tx AS (
  SELECT conversation_no, caller, utterance_index, string_agg(text, ' ' ORDER BY transcript_index) AS text FROM (
    SELECT conversation_no, transcript_index, min(caller) AS caller, min(utterance_index) AS utterance_index, min(coalesce(text, '')) AS text FROM swda_utterance WHERE utterance_index IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2, 3),
tk AS (SELECT row_number() OVER () AS id, conversation_no, caller, utterance_index,
  regexp_extract_all(regexp_replace(regexp_replace(trim(text, e' \t\n\r'), '\s*/\s*$', ''), '<<[^>]*>>|<[^>]*>|\[\[|\]\]', '', 'g'), '(?s)\{[A-Za-z]\s|[\[\]+}]|--|[^\s\[\]+{}/#<>]+|.') AS toks FROM tx),
st AS (
  SELECT id, toks, 0 AS i, '' AS braces, '' AS repairs, CAST([] AS VARCHAR[]) AS words, CAST([] AS INTEGER[]) AS labels FROM tk
  UNION ALL
  SELECT id, toks, i + 1,
    CASE WHEN opens THEN braces || upper(tok[2]) WHEN tok = '}' AND braces <> '' THEN braces[:-2] ELSE braces END,
    CASE WHEN tok = '[' THEN repairs || '1' WHEN tok = '+' AND repairs <> '' THEN repairs[:-2] || '0' WHEN tok = ']' AND repairs <> '' THEN repairs[:-2] ELSE repairs END,
    CASE WHEN is_word THEN list_append(words, word) ELSE words END,
    CASE WHEN is_word THEN list_append(labels, CAST(regexp_matches(braces, '[DFEA]') OR repairs LIKE '%1' OR word LIKE '%-' AS INTEGER)) ELSE labels END
  FROM (
    SELECT *, NOT opens AND tok NOT IN ('[', ']', '+', '}', '--', '{', '/', '#', '<', '>') AND trim(tok, e' \t\n\r') <> '' AND (trim(word, '-') <> '' OR word NOT IN ('', '-', '--')) AS is_word
    FROM (SELECT *, toks[i + 1] AS tok, regexp_full_match(toks[i + 1], '(?s)\{[A-Za-z]\s') AS opens, rtrim(ltrim(lower(toks[i + 1]), '"''(['), '"'')].,;:!?') AS word FROM st WHERE i < len(toks)))),
ls AS (
  SELECT conversation_no, caller, utterance_index, CASE WHEN conversation_no BETWEEN 4000 AND 4199 THEN 'test' WHEN conversation_no BETWEEN 4500 AND 4999 THEN 'valid' ELSE 'train' END AS split, words, labels, list_contains(labels, 1) AS disfluent
  FROM st JOIN tk USING (id) WHERE i = len(st.toks) AND len(words) >= 2),
sen AS (SELECT * FROM ls WHERE split <> 'train' OR disfluent)"""

_CHUNKS = """
ch AS (SELECT file_id, chunk_no, any_value(transcript) AS transcript, any_value(words) AS words FROM asr_json GROUP BY 1, 2),
cx AS (
  SELECT file_id, chunk_no, transcript, list_transform(list_filter(words, lambda x: x.word IS NOT NULL AND trim(x.word) <> '' AND NOT isnan(x.start) AND NOT isnan(x."end") AND x."end" > x.start), lambda x: {'word': x.word, 's': x.start, 'e': x."end"}) AS w FROM ch)"""


def _align(name: str, source: str) -> str:
    """CTEs: `name` (id, ops: list of {r, h, op} in order, 0-based places) of source (id, ref, hyp). A matrix of costs,
    row by row, is read from its end: match or substitution, then deletion, then insertion."""
    return f"""
{name}_0 AS (SELECT id, coalesce(ref, CAST([] AS VARCHAR[])) AS ref, coalesce(hyp, CAST([] AS VARCHAR[])) AS hyp FROM {source}),
{name}_1 AS (
  SELECT id, ref, hyp, 0 AS i, [range(len(hyp) + 1)] AS m FROM {name}_0
  UNION ALL
  SELECT id, ref, hyp, i + 1, list_append(m, list_transform(range(len(hyp) + 1), lambda j: list_min(list_slice(c, 1, j + 1)) + j)) FROM (
    SELECT id, ref, hyp, i, m, list_transform(range(len(hyp) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(m[i + 1][j + 1] + 1, m[i + 1][j] + CAST(hyp[j] <> ref[i + 1] AS BIGINT)) END - j) AS c FROM {name}_1 WHERE i < len(ref))),
{name}_2 AS (
  SELECT id, ref, hyp, m, CAST(len(ref) AS BIGINT) AS i, CAST(len(hyp) AS BIGINT) AS j, CAST([] AS STRUCT(r BIGINT, h BIGINT, op VARCHAR)[]) AS ops FROM {name}_1 WHERE i = len(ref)
  UNION ALL
  SELECT id, ref, hyp, m, CASE WHEN step = 'I' THEN i ELSE i - 1 END, CASE WHEN step = 'D' THEN j ELSE j - 1 END,
    list_prepend({{'r': CASE WHEN step <> 'I' THEN i - 1 END, 'h': CASE WHEN step <> 'D' THEN j - 1 END, 'op': CASE WHEN step = 'X' THEN CASE WHEN ref[i] = hyp[j] THEN 'C' ELSE 'S' END ELSE step END}}, ops)
  FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND m[i][j] + CAST(ref[i] <> hyp[j] AS BIGINT) = m[i + 1][j + 1] THEN 'X' WHEN i > 0 AND m[i][j + 1] + 1 = m[i + 1][j + 1] THEN 'D' ELSE 'I' END AS step FROM {name}_2 WHERE i > 0 OR j > 0)),
{name} AS (SELECT id, ops FROM {name}_2 WHERE i = 0 AND j = 0)"""


_EN = _CHUNKS + f""",
en AS (SELECT row_number() OVER () AS id, file_id, chunk_no, w, string_split({_normal('transcript')}, ' ') AS t FROM cx WHERE transcript IS NOT NULL AND file_id LIKE 'ALL%')"""


def _starts(by: str) -> str:
    """Places (0-based) of the words that begin a stretch, the first left out, of words cut where a pause of at least
    `by` is."""
    return f"list_filter(list_transform(range(1, len(w)), lambda k: CASE WHEN w[k + 1].s - w[k].e < {by}::DOUBLE THEN -1 ELSE k END), lambda k: k > 0)"


_MATCHES = f"""
ga AS (SELECT file_id, idx, s, e, regexp_replace(lower({_normal('label')}), '[^\\w\\p{{L}}\\p{{N}}\\p{{M}}\\x{{200c}}\\x{{200d}}'']', '', 'g') AS token FROM w WHERE NOT pause),
pa AS (SELECT file_id, chunk_no::BIGINT * 4294967296 + pos AS idx, x.s AS s, x.e AS e, regexp_replace(lower({_normal('x.word')}), '[^\\w\\p{{L}}\\p{{N}}\\p{{M}}\\x{{200c}}\\x{{200d}}'']', '', 'g') AS token
  FROM (SELECT file_id, chunk_no, unnest(range(len(w))) AS pos, unnest(w) AS x FROM cx)),
gl AS (SELECT file_id, token, list({{'idx': idx, 's': s, 'e': e}} ORDER BY idx, s, e) AS g FROM ga WHERE token <> '' GROUP BY 1, 2),
pl AS (SELECT file_id, token, list({{'idx': idx, 's': s, 'e': e}}) AS p FROM pa WHERE token <> '' GROUP BY 1, 2),
mt AS (
  SELECT file_id, g, p, 0 AS i, CAST([] AS BIGINT[]) AS used, NULL::STRUCT(d DOUBLE, idx BIGINT, e DOUBLE) AS hit FROM gl JOIN pl USING (file_id, token)
  UNION ALL
  SELECT file_id, g, p, i + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.idx) END, best FROM (
    SELECT file_id, g, p, i, used, list_sort(list_transform(list_filter(p, lambda x: abs(g[i + 1].s - x.s) < 2.0::DOUBLE AND NOT list_contains(used, x.idx)), lambda x: {{'d': abs(g[i + 1].s - x.s), 'idx': x.idx, 'e': x.e}}))[1] AS best FROM mt WHERE i < len(g))),
matched AS (SELECT file_id, g[i].idx AS g_idx, hit.idx AS p_idx, hit.d AS start_error, abs(g[i].e - hit.e) AS end_error FROM mt WHERE i > 0 AND hit IS NOT NULL)"""

_MAP_BACK = f"""
ex AS (SELECT file_id, list({{'idx': idx, 'token': lower(token), 'word': label, 's': s, 'e': e}} ORDER BY idx) AS x FROM (SELECT *, {_token_ja('label')} AS token FROM w WHERE NOT pause) GROUP BY 1),
he AS (SELECT file_id, list(lower(token) ORDER BY idx) AS heard, list(s ORDER BY idx) AS hs, list(e ORDER BY idx) AS he FROM (
  SELECT file_id, chunk_no::BIGINT * 4294967296 + pos AS idx, x.s AS s, x.e AS e, {_token_ja('x.word')} AS token FROM (SELECT file_id, chunk_no, unnest(range(len(w))) AS pos, unnest(w) AS x FROM cx)) GROUP BY 1),
fw AS (
  SELECT file_id, x, coalesce(heard, CAST([] AS VARCHAR[])) AS heard, hs, he, 0 AS i, CAST(0 AS BIGINT) AS here, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM ex LEFT JOIN he USING (file_id)
  UNION ALL
  SELECT file_id, x, heard, hs, he, i + 1, CASE WHEN n > 0 THEN here + n WHEN p > 0 THEN here + p ELSE here END, CASE WHEN n > 0 THEN here WHEN p > 0 THEN here + p - 1 END, CASE WHEN n > 0 THEN here + n WHEN p > 0 THEN here + p END FROM (
    SELECT *, CASE WHEN n > 0 OR here >= len(heard) OR t = '' THEN 0 ELSE coalesce(list_position(list_slice(heard, here + 1, len(heard)), t), 0) END AS p FROM (
      SELECT *, CASE WHEN here >= len(heard) OR t = '' OR heard[here + 1] = t THEN 0 ELSE coalesce(list_filter([2, 3, 4, 5], lambda k: here + k <= len(heard) AND array_to_string(list_slice(heard, here + 1, here + k), '') = t)[1], 0) END AS n
      FROM (SELECT *, x[i + 1].token AS t FROM fw WHERE i < len(x)))))"""

_REPAIR = f"""
rw AS (SELECT row_number() OVER () AS id, file_id, chunk_no, list_max(list_transform(w, lambda x: x.e)) AS last, list_filter(list_sort(list_transform(w, lambda x: {{'s': x.s, 'e': x.e, 'label': {_token_ja('x.word')}}})), lambda x: x.label <> '') AS w FROM cx WHERE len(w) > 0),
rp AS (
  SELECT id, w, 0 AS i, 0.0::DOUBLE AS done, CAST([] AS STRUCT(s DOUBLE, e DOUBLE, label VARCHAR)[]) AS tier FROM rw
  UNION ALL
  SELECT id, w, i + 1, e2, list_concat(tier, list_concat(CASE WHEN s2 > done + 0.001::DOUBLE THEN [{{'s': done, 'e': s2, 'label': ''}}] ELSE [] END, [{{'s': s2, 'e': e2, 'label': w[i + 1].label}}])) FROM (
    SELECT *, CASE WHEN e1 <= s2 THEN s2 + 0.001::DOUBLE ELSE e1 END AS e2 FROM (
      SELECT *, greatest(w[i + 1].s, done) AS s2, CASE WHEN w[i + 1].e <= w[i + 1].s THEN w[i + 1].s + 0.001::DOUBLE ELSE w[i + 1].e END AS e1 FROM rp WHERE i < len(w)))),
rt AS (SELECT file_id, chunk_no, unnest(list_concat(tier, CASE WHEN done < last THEN [{{'s': done, 'e': last, 'label': ''}}] ELSE [] END)) AS x FROM rp JOIN rw USING (id) WHERE i = len(rp.w))"""

_SCORES = """SELECT task, tp, fp, fn, tn, (tp + tn) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 1) AS "precision", coalesce(tp / nullif(tp + fn, 0), 1) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  CASE WHEN abs(1 - x) > 1e-12 THEN ((tp + tn) / n - x) / (1 - x) ELSE 1.0 END AS kappa
FROM (SELECT *, tp + fp + fn + tn AS n, ((tp + fp)::DOUBLE * (tp + fn) + (n - tp - fp)::DOUBLE * (n - tp - fn)) / (n::DOUBLE * n) AS x FROM k)"""

_FILLER_WORDS = "('uh', 'um', 'er', 'hmm')"
SQL = {
    "markup_labels": f"WITH RECURSIVE {_MARKUP} SELECT conversation_no, caller, utterance_index, split, disfluent, array_to_string(words, ' ') AS words, array_to_string(labels, ' ') AS labels FROM sen",
    "split_stats": f"WITH RECURSIVE {_MARKUP} SELECT split, count(*) AS total, count(*) FILTER (disfluent) AS disfluent, count(*) FILTER (NOT disfluent) AS fluent FROM sen GROUP BY 1",
    "word_errors": f"""WITH RECURSIVE {_MARKUP}, x AS (SELECT unnest(words) AS word, unnest(labels) AS gold FROM sen)
SELECT word, count(*) FILTER (gold = 1 AND word NOT IN {_FILLER_WORDS}) AS missed, count(*) FILTER (gold = 0 AND word IN {_FILLER_WORDS}) AS false_positive, count(*) FILTER (gold = 1 AND word IN {_FILLER_WORDS}) AS correct FROM x GROUP BY 1""",
    "disfluency_tagging": f"""WITH RECURSIVE {_MARKUP}, x AS (SELECT conversation_no, caller, utterance_index, words, list_transform(words, lambda y: CAST(rtrim(y, ',.') IN {_FILLER_WORDS} OR y LIKE '%-' AS INTEGER)) AS labels FROM sen)
SELECT conversation_no, caller, utterance_index, array_to_string(words, ' ') AS words, array_to_string(labels, ' ') AS labels, array_to_string(list_filter(words, lambda y, k: labels[k] = 0), ' ') AS cleaned FROM x""",
    "label_derivation": f"""WITH RECURSIVE {_MARKUP}, f AS (SELECT row_number() OVER () AS id, conversation_no, caller, utterance_index, words, labels, list_filter(words, lambda y, k: labels[k] = 0) AS kept FROM sen),
g AS (SELECT *, CASE WHEN len(kept) = 1 AND kept[1] = 'None' THEN [] ELSE kept END AS fl FROM f),
d AS (
  SELECT id, words, fl, len(words) AS i, len(fl) AS n, CAST([] AS INTEGER[]) AS derived FROM g
  UNION ALL SELECT id, words, fl, i - 1, CASE WHEN n > 0 AND fl[n] = words[i] THEN n - 1 ELSE n END, list_prepend(CASE WHEN n > 0 AND fl[n] = words[i] THEN 0 ELSE 1 END, derived) FROM d WHERE i > 0)
SELECT conversation_no, caller, utterance_index, CASE WHEN n = 0 THEN array_to_string(derived, ' ') END AS derived, array_to_string(labels, ' ') AS labels FROM d JOIN g USING (id) WHERE i = 0""",
    "word_error_rates": f"""WITH RECURSIVE {_EN}, q AS (SELECT id, t AS ref, list_transform(w, lambda x: {_normal('x.word')}) AS hyp FROM en), {_align('al', 'q')}
SELECT file_id, chunk_no, len(list_filter(ops, lambda o: o.op <> 'C')) / greatest(len(t), 1) AS wer, {', '.join(f"CAST(len(list_filter(ops, lambda o: o.op = '{o}')) AS INTEGER) AS n_{o.lower()}" for o in 'CSDI')} FROM al JOIN en USING (id)""",
    "boundary_agreement": f"""WITH RECURSIVE {_EN}, e2 AS (SELECT * FROM en WHERE len(w) > 1), q1 AS (SELECT id, list_transform(w, lambda x: x.word) AS ref, t AS hyp FROM e2), q2 AS (SELECT id, t AS ref, list_transform(w, lambda x: x.word) AS hyp FROM e2),
{_align('a1', 'q1')}, {_align('a2', 'q2')},
b AS (SELECT e2.id, file_id, {_starts('0.25')} AS gb, {_starts('0.6')} AS ab FROM e2),
c AS (SELECT id, file_id, ab, list_transform(list_filter(a1.ops, lambda o: o.op IN ('C', 'S') AND list_contains(gb, o.r)), lambda o: o.h) AS cb, unnest(a2.ops) AS o FROM b JOIN a1 USING (id) JOIN a2 USING (id)),
p AS (SELECT file_id, coalesce(list_contains(cb, o.r), false) AS g, coalesce(list_contains(ab, o.h), false) AS a FROM c),
k AS (SELECT task, count(*) FILTER (a AND g) AS tp, count(*) FILTER (a AND NOT g) AS fp, count(*) FILTER (NOT a AND g) AS fn, count(*) FILTER (NOT a AND NOT g) AS tn FROM (
  SELECT unnest(['Overall', CASE WHEN contains(file_id, 'ST1') THEN 'ST1' ELSE 'ST2' END]) AS task, a, g FROM p) GROUP BY 1) {_SCORES}""",
    "gold_to_time": f"""WITH RECURSIVE {_EN}, e2 AS (SELECT * FROM en WHERE len(w) > 0), q AS (SELECT id, t AS ref, list_transform(w, lambda x: x.word) AS hyp FROM e2), {_align('al', 'q')},
o AS (SELECT file_id, chunk_no, w, unnest(ops) AS o FROM al JOIN e2 USING (id))
SELECT file_id, chunk_no, CAST(o.r // 10 AS INTEGER) AS idx, arg_min(w[o.h + 1].s, o.r) AS s, arg_max(w[o.h + 1].e, o.r) AS e FROM o WHERE o.op IN ('C', 'S') GROUP BY 1, 2, 3""",
    "greedy_match": f"WITH RECURSIVE {WORDS}, {_CHUNKS}, {_MATCHES} SELECT * FROM matched",
    "timing_percentiles": f"""WITH RECURSIVE {WORDS}, {_CHUNKS}, {_MATCHES}, x AS (SELECT unnest([start_error, end_error]) AS x FROM matched)
SELECT count(*) AS n, sum(CAST(x AS DECIMAL(28,9)))::DOUBLE / count(*) * 1000 AS mean_ms, quantile_cont(x, 0.5) * 1000 AS median_ms, quantile_cont(x, 0.9) * 1000 AS p90_ms FROM x""",
    "aligner_map_back": f"""WITH RECURSIVE {WORDS}, {_CHUNKS}, {_MAP_BACK}
SELECT file_id, x[i].idx AS idx, x[i].word AS word, round(coalesce(hs[a + 1], x[i].s), 3) AS "start", round(coalesce(he[b], CASE WHEN x[i].e > x[i].s THEN x[i].e ELSE x[i].s + 0.001::DOUBLE END), 3) AS "end", CASE WHEN a IS NULL THEN 'rough' ELSE 'mfa' END AS source FROM fw WHERE i > 0""",
    "timeline_repair": f"WITH RECURSIVE {_CHUNKS}, {_REPAIR} SELECT file_id, chunk_no, x.s AS s, x.e AS e, x.label AS label FROM rt",
    "retokenised": f"""WITH {_CHUNKS}, o AS (SELECT file_id, chunk_no, CAST(unnest(range(len(w))) AS INTEGER) AS idx, unnest(w) AS x FROM cx),
p AS (SELECT *, list_filter(regexp_extract_all(x.word, '[一-鿿]+|[ァ-ヺー]+|[ぁ-ゖ]+|[^一-鿿ァ-ヺーぁ-ゖ]+'), lambda y: regexp_matches(y, '[^{_WS[1:-2]}]')) AS c FROM o),
q AS (SELECT *, CASE WHEN len(c) > 1 AND array_to_string(c, '') = x.word THEN c ELSE [x.word] END AS d FROM p),
n AS (SELECT *, list_transform(range(len(d) + 1), lambda k: coalesce(list_sum(list_transform(list_slice(d, 1, k), lambda y: length(y))), 0)) AS b FROM q),
u AS (SELECT *, CAST(unnest(range(len(d))) AS INTEGER) AS sub FROM n)
SELECT file_id, chunk_no, idx, sub, d[sub + 1] AS word, x.s + (x.e - x.s) * b[sub + 1] / b[len(d) + 1] AS s, x.s + (x.e - x.s) * b[sub + 2] / b[len(d) + 1] AS e FROM u""",
    "sample_documents": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 5",
}
QUERIES: dict = {}
