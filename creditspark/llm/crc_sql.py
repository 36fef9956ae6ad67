"""DuckDB SQL for the contracts that hash texts by crc32, which DuckDB lacks.

``CRC_TABLE`` is a common table expression of one row with the 256 steps of the
polynomial; ``crc32_of`` folds a text's UTF-8 bytes through them.
"""

from __future__ import annotations

# The reversed CRC-32 polynomial is a fixed value.
CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(
      list_prepend(b, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps)"""


def crc32_of(text: str, steps: str = "steps") -> str:
    """The unsigned crc32 of ``text``; the row has ``steps`` of ``CRC_TABLE``."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      range(1, 1 + length(hex({text})) // 2), lambda i: ('0x' || substr(hex({text}), 2 * i - 1, 2))::BIGINT)),
      lambda c, b: xor({steps}[1 + (xor(c, b) & 255)], c >> 8)))"""


SPELLING_VARIANTS = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS prefix, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run
  FROM documents),
hashed AS (
  SELECT run, length(run) AS len, n, {crc32_of("(prefix || run)")} AS h
  FROM (SELECT prefix, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL), crc_table),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % len) || substr(run, h % len + 2) ELSE run END AS word, n FROM hashed),
vocab AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
lost AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, 1 + length(word))) AS i FROM vocab)),
near AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM lost a JOIN lost b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word FROM lost a JOIN vocab b ON a.rest = b.word
  UNION
  SELECT b.word, a.word FROM lost a JOIN vocab b ON a.rest = b.word),
best AS MATERIALIZED (
  SELECT near.a AS word, count(*) AS n_near, min({{'less': -b.n, 'word': near.b}}) AS x
  FROM near JOIN vocab b ON b.word = near.b GROUP BY near.a),
form AS MATERIALIZED (
  SELECT v.word, best.x.word AS form, -best.x.less AS form_n
  FROM vocab v JOIN best ON best.word = v.word WHERE -best.x.less >= 10 * v.n),
lead AS (
  SELECT word, form AS root, 1 AS step FROM form
  UNION ALL
  SELECT lead.word, form.form, step + 1 FROM lead JOIN form ON form.word = lead.root),
roots AS (SELECT word, arg_max(root, step) AS root FROM lead GROUP BY word)
SELECT v.word, form.form, coalesce(roots.root, v.word) AS root, v.n, coalesce(best.n_near, 0) AS n_near, form.form_n::BIGINT AS form_n
FROM vocab v LEFT JOIN best ON best.word = v.word LEFT JOIN form ON form.word = v.word LEFT JOIN roots ON roots.word = v.word
"""

# A null doc_id is left as it is: the checksum of '1' is no multiple of ten.
PERIODIC_RUNS = f"""
WITH {CRC_TABLE},
split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
hashed AS (SELECT doc_id, ws, len(ws) AS n, {crc32_of("coalesce(doc_id::VARCHAR, '1')")} AS h FROM split, crc_table),
placed AS (
  SELECT doc_id, ws, n, h % 10 = 0 AND n > 0 AS again, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a, 3 + (h // 10) % 8 AS parts
  FROM hashed),
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, n, CASE WHEN again
      THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // parts) + 1] END)
      ELSE ws END AS ws
  FROM placed),
word AS MATERIALIZED (SELECT d, n, unnest(range(0, n)) AS i, unnest(ws) AS w FROM docs),
same AS (
  SELECT x.d, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.d = y.d AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 2),
stretch AS (
  SELECT d, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT d, q, i, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS island FROM same)
  GROUP BY d, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
run AS MATERIALIZED (SELECT d, start, length, min(q) AS period FROM stretch GROUP BY d, start, length),
found AS (
  SELECT d, count(*) AS n_runs, min({{'less': -length, 'start': start, 'period': period}}) AS best,
      string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM run GROUP BY d),
kept AS (
  SELECT d, string_agg(w, ' ' ORDER BY i) AS words FROM word
  WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.d = word.d AND word.i >= run.start + run.period AND word.i < run.start + run.length)
  GROUP BY d)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, (-best.less)::BIGINT AS length, best.period AS period,
    ((1000 * -best.less) // best.period)::BIGINT AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM docs LEFT JOIN found ON found.d = docs.d LEFT JOIN kept ON kept.d = docs.d
"""
