"""The queries that SQL can express, for DuckDB over the same tables."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(pattern: str) -> str:
    return f"coalesce(regexp_extract_all({_LOWER}, '{pattern}'), [])"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A run of letters; the step of CRC-32 for one bit.
_LETTERS = r"[A-Za-z\x{00C0}-\x{00FF}]+"
_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END"
_NOT_SPACE = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op6_decontaminate": f"""
WITH docs AS MATERIALIZED (SELECT doc_id, {_words(_ALNUM)} AS ws FROM documents),
items AS MATERIALIZED (
  SELECT item_id, ws, least(len(ws), 10) AS n FROM (SELECT item_id, {_words(_ALNUM)} AS ws FROM benchmark)
  WHERE len(ws) > 0),
wanted AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(ws[a:a + n - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS a FROM items)),
found AS MATERIALIZED (
  SELECT doc_id, n, a, item_id FROM (
    SELECT doc_id, n, a, array_to_string(ws[a:a + n - 1], ' ') AS win FROM (
      SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS a
      FROM docs, (SELECT DISTINCT n FROM items) WHERE len(ws) >= n))
  JOIN wanted USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS w FROM found) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op7_ngram_join": f"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, {_words(_NOT_SPACE)} AS ws FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[a:a + 4], ' ') AS s FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS a FROM docs WHERE len(ws) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
  UNION ALL
  SELECT b, a FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)""",
    "op11_spelling": f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, x: {_BIT}) ORDER BY i) AS t FROM range(256) r(i)),
runs AS MATERIALIZED (
  SELECT doc_id, w, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '{_LETTERS}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
    FROM documents) WHERE length(w) >= 6 GROUP BY 1, 2),
hashed AS MATERIALIZED (
  SELECT w, k, xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(str_split(doc_id || ':' || w, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [195::UBIGINT, (unicode(c) - 64)::UBIGINT] END))),
    lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS h
  FROM runs, crc),
words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 199 = 0 THEN w[:(h % length(w))::BIGINT] || w[(h % length(w))::BIGINT + 2:] ELSE w END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
cut AS MATERIALIZED (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM cut a JOIN words w ON w.word = a.rest
  UNION SELECT w.word, a.word, a.n FROM cut a JOIN words w ON w.word = a.rest),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top, first(other ORDER BY other_n DESC, other) AS other FROM near GROUP BY 1),
found AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 5 * n THEN other END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root FROM words UNION SELECT w.word, f.form FROM walk w JOIN found f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM found f JOIN walk w USING (word) JOIN found e ON e.word = w.root WHERE e.form IS NULL""",
    "op13_lexical_search": f"""
WITH docs AS MATERIALIZED (SELECT doc_id, unnest({_words(_ALNUM)}) AS term FROM documents),
lengths AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM docs GROUP BY 1),
totals AS MATERIALIZED (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
asked AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest({_words(_ALNUM)}) AS term FROM benchmark) GROUP BY 1, 2),
postings AS MATERIALIZED (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM docs WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weights AS MATERIALIZED (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term, n_docs),
scored AS MATERIALIZED (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY 1, 2)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20""",
}
