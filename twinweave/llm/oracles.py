"""DuckDB SQL for those training-data queries that SQL can express."""

from __future__ import annotations

from twinweave.llm import mixing
from twinweave.llm import quality_rules as rules

_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_WORD}')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH sizes AS (SELECT row_number() OVER () AS rid, doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, list_extract([3, 1, 2], (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS weight, (source_size * 2)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM per),
levels AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / (sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS l FROM weighed),
targets AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM (SELECT *, max(CASE WHEN l * weight <= cap THEN l END) OVER () AS level FROM levels)),
queued AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sizes),
rounds AS (SELECT rid, key, doc_id, queued.source, size, source_size, target, round, source_size * round + start AS begun FROM queued JOIN targets ON queued.source IS NOT DISTINCT FROM targets.source, (SELECT unnest([0, 1]) AS round)),
packets AS (SELECT *, least({mixing.QUANTUM}, size - {mixing.QUANTUM} * k) AS words, (begun + least(size, {mixing.QUANTUM} * (k + 1)))::DOUBLE / target AS finish FROM (SELECT *, unnest(range(0, (size + {mixing.QUANTUM} - 1) // {mixing.QUANTUM})) AS k FROM rounds WHERE target > 0 AND size > 0)),
stream AS (SELECT rid, words, sum(words) OVER (ORDER BY finish, source IS NULL, source, round, key, doc_id, size, k ROWS UNBOUNDED PRECEDING) AS upto FROM packets),
taken AS (SELECT rid, sum(greatest(0, least(words, (SELECT floor(sum(target) + 0.5) FROM targets) - (upto - words)))) AS taken FROM stream GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued JOIN targets ON queued.source IS NOT DISTINCT FROM targets.source LEFT JOIN taken USING (rid)
"""

OP10 = f"""
WITH RECURSIVE tok AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM tok),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS item, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.item),
comp AS (SELECT item, min(r) AS c FROM reach GROUP BY item)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON item = d.doc_id
"""

_U = rules.UNUSUAL
_COUNT = "length(regexp_replace(coalesce(text, ''), '[^{c}]', '', 'g'))"
_CUTS = "[" + ", ".join(f"{c}::DOUBLE" for c in rules.CUTOFFS) + "]"
OP2 = f"""
WITH tok AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM tok WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2, 3, 4]) AS p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM tok) WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
adj AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM tok) WHERE w[i] = w[i - 1] GROUP BY doc_id),
stats AS (SELECT tok.doc_id, lang, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {_COUNT.format(c="#*$%&|<>")}::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  {_COUNT.format(c="|")} AS pipes, {_COUNT.format(c="!")} AS bangs, {_COUNT.format(c="A-Z")} AS upper, {_COUNT.format(c="a-z")} AS lower, coalesce(adj.n, 0) AS adj, coalesce(dup.n_lines, 0) AS n_lines
  FROM tok LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN adj USING (doc_id)),
marked AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_symbols / (n_words + 5)::DOUBLE / {_U["symbols"]}::DOUBLE, pipes / (n_words + 5)::DOUBLE / {_U["pipes"]}::DOUBLE, bangs / (n_words + 5)::DOUBLE / {_U["bangs"]}::DOUBLE,
  upper / (upper + lower + 20)::DOUBLE / {_U["upper"]}::DOUBLE, n_repeat_words / (n_words + 5)::DOUBLE / {_U["repeats"]}::DOUBLE, adj / (n_words + 5)::DOUBLE / {_U["adjacent"]}::DOUBLE, n_dup_lines / (n_lines + 1)::DOUBLE / {_U["dup_lines"]}::DOUBLE) AS severity FROM stats),
held AS (SELECT DISTINCT lang, text, severity FROM marked WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1)),
strata AS (SELECT lang, count(*) AS n, count(*) OVER () AS m FROM held GROUP BY lang),
tested AS (SELECT s.lang, s.n, s.m, c.i, c.cut, (SELECT count(*) FROM held h WHERE h.lang IS NOT DISTINCT FROM s.lang AND h.severity > c.cut) AS k FROM strata s, (SELECT unnest(range(1, {len(rules.CUTOFFS) + 1})) AS i, unnest({_CUTS}) AS cut) c),
tails AS (SELECT t.*, (SELECT sum(exp(lgamma(t.n + 1) - lgamma(j + 1) - lgamma(t.n - j + 1) + j * ln({rules.ALPHA}::DOUBLE) + (t.n - j) * ln(1 - {rules.ALPHA}::DOUBLE))) FROM range(t.k + 1) r(j)) AS p FROM tested t),
chosen AS (SELECT lang, min(cut) AS cutoff FROM (SELECT *, bool_and(p <= {rules.DELTA}::DOUBLE / m) OVER (PARTITION BY lang ORDER BY i) AS ok FROM tails) WHERE ok GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (cutoff IS NULL OR severity <= cutoff) AS kept, severity, cutoff FROM marked LEFT JOIN chosen ON marked.lang IS NOT DISTINCT FROM chosen.lang
"""

OP11 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, {_WORDS} AS w FROM documents),
least AS (SELECT text, min(doc_id) AS low FROM docs GROUP BY text),
failed AS (SELECT part, d.doc_id,
  [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(low < d.doc_id, false)] AS f,
  d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM docs d JOIN least USING (text)),
counts AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, f),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS l),
orders AS (SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
told AS (SELECT part, o, step, o[step] AS own, coalesce(sum(n) FILTER (NOT list_bool_or([f[i] for i in o[:step]])), 0) AS kept,
  coalesce(sum(n) FILTER (f[o[step]] AND NOT coalesce(list_bool_or([f[i] for i in o[:step - 1]]), false)), 0) AS removed, coalesce(sum(n) FILTER (f[o[step]] AND coalesce(list_bool_or([f[i] for i in o[:step - 1]]), false)), 0) AS redundant,
  coalesce(sum(n) FILTER (f[o[step]] AND len(list_filter(f, lambda x: x)) = 1), 0) AS unique_fails,
  coalesce(sum(good) FILTER (f[o[step]] AND NOT coalesce(list_bool_or([f[i] for i in o[:step - 1]]), false)), 0) AS good_lost, coalesce(sum(toxic) FILTER (f[o[step]] AND NOT coalesce(list_bool_or([f[i] for i in o[:step - 1]]), false)), 0) AS toxic_lost
  FROM counts, steps GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM told
"""

OP12 = """
WITH ok AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, list_sum(list_transform(list_zip(a.v, o.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM ok a JOIN ok o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id),
pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT pos.anchor_id, positive_id, row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scored ON pos.anchor_id = scored.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""

ORACLE_SQL = {"op11_filter_audit": OP11, "op12_hard_negatives": OP12, "op2_quality_rules": OP2, "op4_weighted_mix": OP4, "op10_jaccard_join": OP10}
