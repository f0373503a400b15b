"""SQL for DuckDB that gives the rows of the queries that SQL can express, written from their definitions."""

# Words are [^\\x20\\x09-\\x0D]+.  Base statistics: as their contract defines them.  Verdict: a line with a word fails if
# no sentence ends in it (and the next line doesn't begin with a small letter), or it is symbolic, navigation, no prose,
# shouting or boilerplate; a line that repeats an earlier one
# counts as failing; a document is kept if its other passing lines hold at least half of the characters of its lines with a word.
OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
base AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS worded FROM w),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
numbered AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM base),
lines AS (SELECT doc_id, x, coalesce(regexp_matches(lead(x) OVER (PARTITION BY doc_id ORDER BY i), '^\p{Ll}'), false) AS goes_on FROM numbered QUALIFY row_number() OVER (PARTITION BY doc_id, x ORDER BY i) = 1),
chars AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS n,
  length(regexp_replace(x, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(x, '[^\p{Lu}]+', '', 'g')) AS capitals,
  length(regexp_replace(x, '[^|\x{00bb}\x{203a}\x{00b7}\x{2022}\x{2192}]+', '', 'g')) AS separators,
  length(regexp_replace(x, '[^#*$%&|<>{}~^=\\@_]+', '', 'g')) AS symbols,
  regexp_matches(x, '[.!?:;\x{2026}]["'')\]\x{201d}\x{2019}\x{00bb}]*(?:[\x20\x09-\x0D]|$)|[\x{3002}\x{ff01}\x{ff1f}]') AS ends FROM lines),
passing AS (SELECT doc_id, sum(length(x)) AS size FROM chars WHERE words > 0
  AND (ends OR goes_on)
  AND NOT ((n - letters) * 5 > n AND symbols * 5 > n)
  AND NOT (separators >= 2 AND separators * 2 >= words - separators)
  AND NOT (letters * 2 < n AND n >= 8)
  AND NOT (letters >= 12 AND words >= 3 AND regexp_matches(x, '\p{Lu}[^\p{L}]?\p{Lu}') AND capitals * 2 > letters)
  AND NOT (words <= 12 AND regexp_matches(lower(x), 'cookie|privacy policy|terms of use|terms of service|all rights reserved|copyright \(c\)|subscribe to|sign up for|click here|read more|share this|log in|javascript|released under the|licensed under|lorem ipsum'))
  GROUP BY doc_id),
r AS (SELECT b.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(worded) - len(list_distinct(worded)) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, coalesce(p.size, 0) AS passed, list_sum(list_transform(worded, lambda x: length(x))) AS whole FROM base b LEFT JOIN covered c USING (doc_id) LEFT JOIN passing p USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_words = 0 OR 1 - passed::DOUBLE / whole <= 0.5) AS kept FROM r
"""

ORACLE = {"op9_lines": OP9}

# Filters: A under 100 words, B distinct words under 80 %, C capitals A-Z over 10 % of the code points, D one of # $ % & * |,
# E a text that a smaller doc_id has, too.
OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END ||
  CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END ||
  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
steps AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS earlier FROM orders, range(1, 6) r(step)),
s AS (SELECT part, filter_order, step, x, good, toxic, contains(fails, x) AS failing, fails = x AS only_this,
  len(regexp_extract_all(fails, '[' || earlier || '_]')) > 0 AS gone FROM f, steps),
c AS (SELECT part, filter_order, step, x, count(*) FILTER (NOT gone AND NOT failing) AS kept, count(*) FILTER (NOT gone AND failing) AS removed,
  count(*) FILTER (gone AND failing) AS redundant, count(*) FILTER (only_this) AS unique_fails,
  count(*) FILTER (NOT gone AND failing AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND failing AND toxic = 1) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM c
"""

ORACLE["op12_audit"] = OP12


def op11(parts: int = 4, most: int = 256, rounds: int = 4) -> str:
    """Exact search by all distances, a table for each round; for vectors of one length."""
    steps = []
    nearest = "SELECT v.vec_id, v.rid, v.part, v.x, arg_min(b.entry, (list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), b.entry)) AS entry, min(list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM v JOIN {book} b ON b.part = v.part GROUP BY ALL"
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(book=f'b{k}')})")
        steps.append(f"m{k} AS (SELECT part, entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS y FROM a{k}, range(1, {{width}} + 1) r(i) GROUP BY ALL)")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(any_value(n.x), any_value(b.x)) AS x FROM b{k} b LEFT JOIN (SELECT part, entry, list(y ORDER BY i) AS x FROM m{k} GROUP BY ALL) n ON n.part = b.part AND n.entry = b.entry GROUP BY b.part, b.entry)")
    body = ",\n".join(steps).replace("{width}", f"(SELECT len(embedding) // {parts} FROM e LIMIT 1)")
    return f"""
WITH e AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, rid, p AS part, list_transform(embedding[p * len(embedding) // {parts} + 1:(p + 1) * len(embedding) // {parts}], lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM e, range({parts}) r(p)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM v WHERE rid <= {most}),
{body},
last AS MATERIALIZED ({nearest.format(book=f"b{rounds}")}),
c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY rid)
SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM e JOIN c USING (rid)
"""


ORACLE["op11_codes"] = op11()
