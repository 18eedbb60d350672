"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables.

The others hash with XXH64, run tokenizers, or train models, for which DuckDB has
nothing; tests/llm holds them against brute force, round trips or held-out rows.
"""

from __future__ import annotations

from .quality import LEAST_WORDS, ROUNDS, THRESHOLD

_W = r"[^\x20\x09-\x0D]"
_POSTERIOR = """1 / (1 + exp(-(ln(good / (1 - good)) + list_sum(list_transform(range(1, 9), lambda j:
    CASE p.v[j] WHEN 1 THEN ln(acc[j] / (1 - acc[j])) WHEN 0 THEN ln((1 - acc[j]) / acc[j]) ELSE 0.0 END)))))"""

QUALITY = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls FROM d),
three AS (SELECT rid, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS gs FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, unnest(gs) AS g, generate_subscripts(gs, 1) AS i FROM three),
twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
f AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper,
  length(t) - length(replace(t, '!', '')) AS n_marks, len(list_filter(ws, lambda x: regexp_full_match(x, '\\pL+[.,;:?]?'))) AS n_plain, len(ls) AS n_lines
  FROM w LEFT JOIN covered USING (rid)),
v AS (SELECT *, greatest(n_words, 1)::DOUBLE AS n, [
  CASE WHEN n_plain / n >= 0.85 THEN 1 WHEN n_plain / n < 0.65 THEN 0 ELSE -1 END,
  CASE WHEN n_symbols / n > 0.1 THEN 0 WHEN n_symbols / n < 0.02 THEN 1 ELSE -1 END,
  CASE WHEN n_upper > 0.35::DOUBLE * word_chars THEN 0 ELSE -1 END,
  CASE WHEN n_marks / n > 0.2 THEN 0 ELSE -1 END,
  CASE WHEN n_repeat_words / n > 0.3 THEN 0 WHEN n_repeat_words / n < 0.1 THEN 1 ELSE -1 END,
  CASE WHEN n_dup_lines > 0.3::DOUBLE * n_lines THEN 0 ELSE -1 END,
  CASE WHEN word_chars > 15 * n OR word_chars < 2 * n THEN 0 ELSE -1 END,
  CASE WHEN n_words < {LEAST_WORDS} THEN 0 ELSE -1 END] AS votes FROM f),
pat AS (SELECT list({{'v': votes, 'n': k}} ORDER BY votes) AS ps FROM (SELECT votes, count(*)::DOUBLE AS k FROM v GROUP BY votes)),
em(k, good, acc) AS (SELECT 0, 0.8::DOUBLE, list_transform(range(8), lambda j: 0.8::DOUBLE)
  UNION ALL
  SELECT k + 1, least(greatest(list_sum(list_transform(q, lambda p: p.n * p.g)) / list_sum(list_transform(q, lambda p: p.n)), 0.05), 0.95),
    list_transform(range(1, 9), lambda j: least(greatest(
      (list_sum(list_transform(q, lambda p: p.n * CASE p.v[j] WHEN 1 THEN p.g WHEN 0 THEN 1 - p.g ELSE 0.0 END)) + 8.0) /
      (list_sum(list_transform(q, lambda p: CASE WHEN p.v[j] >= 0 THEN p.n ELSE 0.0 END)) + 10.0), 0.55), 0.995))
  FROM (SELECT k, list_transform(ps, lambda p: {{'v': p.v, 'n': p.n, 'g': {_POSTERIOR}}}) AS q FROM em, pat WHERE k < {ROUNDS})),
last AS (SELECT good, acc FROM em WHERE k = {ROUNDS}),
s AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  {_POSTERIOR.replace("p.v", "votes")} AS posterior FROM v, last)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= {THRESHOLD} AS kept, round(posterior, 9) AS posterior FROM s
"""

HARD_NEGATIVES = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, v.r, v.vec_id, a.label = v.label AS same, list_dot_product(a.q, v.q)::BIGINT AS score FROM v a JOIN v ON a.r <> v.r AND len(a.q) = len(v.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id, s.r)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= 5
"""

ORACLES: dict[str, str] = {"op1_quality": QUALITY, "op11_hard_negatives": HARD_NEGATIVES}
