"""DuckDB SQL of the registered queries, where SQL can express them."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH docs AS (SELECT doc_id, {WORDS} AS words FROM documents),
win AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM docs)),
bad AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY w) AS low FROM win)
  WHERE low < doc_id),
one AS (
  SELECT doc_id, words[pos] AS word, pos,
         max(b) OVER (PARTITION BY doc_id ORDER BY pos) AS last_bad
  FROM (SELECT d.doc_id, d.words, d.pos, b.pos AS b
        FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM docs) d
        LEFT JOIN bad b ON b.doc_id = d.doc_id AND b.pos = d.pos)),
marked AS (SELECT *, coalesce(pos - last_bad < 13, false) AS gone FROM one)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, count(m.pos) FILTER (WHERE m.gone) AS n_removed,
       sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.pos) FILTER (WHERE NOT m.gone), '')) AS kept_sha256
FROM docs d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id, len(d.words)
"""

OP3 = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, length(text) + len(regexp_extract_all(text,
           '\\|<</SYS>>|</TURN>|<<SYS>>|\[/INST\]|\[INST\]|<TURN|<ANS>|</s>|<s>')) AS chars,
         CASE role WHEN 'system' THEN 8 + 9 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 6 + 5 END AS marks,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars + marks))::BIGINT AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN before IS NULL
                          WHEN 'user' THEN coalesce(before, 'system') IN ('system', 'assistant')
                          WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END
                AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM escaped GROUP BY conv_id
"""

OP9 = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
bad AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(b.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN bad b USING (key) GROUP BY doc_id
"""

OP10 = rf"""
WITH docs AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight,
         2 * source_size AS cap FROM src),
steps AS (
  SELECT *, row_number() OVER fill AS step,
         3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER before, 0) AS left_,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM ranked
  WINDOW fill AS (ORDER BY cap / weight, source NULLS LAST),
         before AS (ORDER BY cap / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (
  SELECT min(step) AS step, arg_min(left_, step) AS left_, arg_min(weight_left, step) AS weight_left
  FROM steps WHERE 2 * cap * weight_left > left_ * weight),
targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN t.step IS NULL OR s.step < t.step THEN s.cap::DOUBLE
              ELSE (s.weight * t.left_)::DOUBLE / (2 * t.weight_left)::DOUBLE END AS target
  FROM steps s, stop t),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
         coalesce(sum(d.size) OVER (
           PARTITION BY d.source ORDER BY md5('mix-' || coalesce(CAST(d.doc_id AS VARCHAR), 'null'))
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole * size + greatest(0, least(floor(target)::BIGINT - whole * source_size - before, size)))::BIGINT AS taken
FROM placed
"""

OP11 = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY ALL),
crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z:
    CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
hashed AS (
  SELECT run, c, xor(list_reduce(list_concat([4294967295], flatten(list_transform(
           string_split(coalesce(doc_id::VARCHAR, 'null') || ':' || run, ''), lambda x:
           CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END))),
         lambda v, b: xor(v // 256, t[xor(v % 256, b) + 1])), 4294967295) AS h
  FROM runs, crc),
words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, c
        FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cuts AS (
  SELECT word, i, word[:i - 1] || '_' || word[i + 1:] AS wild, word[:i - 1] || word[i + 1:] AS cut
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cuts c JOIN words w ON w.word = c.cut),
near AS (
  SELECT x.word AS a, y.word AS b FROM cuts x JOIN cuts y ON x.wild = y.wild AND x.word <> y.word
  UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter),
ranked AS (
  SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k
  FROM near JOIN words ON word = b),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.n >= 2 * w.n THEN r.b END AS form,
         CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.k = 1),
chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.at AND e.form IS NULL
"""

OP13 = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS (
  SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) t(k))
  GROUP BY ALL),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
cand AS (SELECT * FROM f WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, c.j, x.f AS l, y.f AS r,
         (1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[:c.j] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.j + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_ AS (
  SELECT lang, g, max(f) AS longer
  FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, f FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.g = b.g
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN total t ON t.lang = k.lang QUALIFY rank <= 2000
"""

SQL = {"op2_substring_dedup": OP2, "op3_chat_format": OP3,
       "op9_line_dedup": OP9, "op10_source_mix": OP10,
       "op11_spelling_variants": OP11, "op13_phrase_collocations": OP13}
