"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from trackline.llm.quality_rules import BOILERPLATE

WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), leveled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
             - coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0)
            / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
         source_size / weight AS ratio
  FROM totals WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), marked AS (
  SELECT *, source_size * 2.0::DOUBLE <= level * weight AS is_full FROM leveled
), targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN source_size * 2.0::DOUBLE ELSE
           (SELECT arg_min(level, ratio) FROM marked WHERE NOT is_full) * weight END AS target
  FROM marked
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets
), ranked AS (
  SELECT s.doc_id, s.size, p.*, CASE WHEN source_size > 0 THEN target / source_size - copies ELSE 0.0::DOUBLE END AS p,
         (('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
           / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
), summed AS (
  SELECT *, coalesce(sum(size) OVER (
      PARTITION BY source ORDER BY (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked
)
SELECT doc_id, size, source_size, target,
       (copies * size + CASE WHEN p > 0 THEN
          least(greatest(floor(target - copies * source_size - before + 0.5::DOUBLE), 0), size) ELSE 0 END)::BIGINT AS taken
FROM summed
"""

QUALITY = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), split AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '{WORD}') AS words, string_split(text, chr(10)) AS lines FROM docs
), line AS (
  SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM split
), counted AS (
  SELECT r, line, n, regexp_extract_all(line, '{WORD}') AS w FROM line
), failing AS (
  SELECT r, line, len(w) AS n_words, len(w) > 0 AND (
      (sep >= 3 AND sep * 4 >= len(w)) OR marked * 100 >= 30 * len(w)
      OR {" OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)}) AS fails
  FROM (SELECT *, len(list_filter(w, lambda x: x IN ('|', '>', '/', '»', '·', '•'))) AS sep,
               len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]|!!$'))) AS marked FROM counted)
), dup AS (
  SELECT r, sum(c - 1)::BIGINT AS n_dup_lines FROM (
    SELECT r, line, count(*) AS c FROM counted WHERE len(w) > 0 GROUP BY r, line) GROUP BY r
), lost AS (
  SELECT r, sum(CASE WHEN fails THEN n_words ELSE 0 END)::BIGINT AS lost,
         sum(fails::INT)::BIGINT AS n_failing FROM failing GROUP BY r
), word AS (
  SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split
), gram AS (
  SELECT r, i, w, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d, lead(w, 4) OVER o AS e
  FROM word WINDOW o AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT r, i, e IS NOT NULL AND count(*) OVER (PARTITION BY r, w, b, c, d, e) > 1 AS hit FROM gram
), covered AS (
  SELECT r, max(hit::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS cover FROM twice
), repeats AS (
  SELECT r, sum(cover)::BIGINT AS n_repeat_words FROM covered GROUP BY r
), counts AS (
  SELECT s.r, doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost, n_failing
  FROM split s LEFT JOIN dup USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r)
), verdict AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost * 100 <= 40 * n_words AS kept,
       CASE WHEN base_failed THEN 0 ELSE n_failing END AS n_lines_removed
FROM verdict
"""

LINES = r"""
WITH docs AS (
  SELECT doc_id, text, source, string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS r
  FROM documents
), line AS (
  SELECT r, coalesce(text, '') AS text, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM docs
), keyed AS (
  SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM line
), bad AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce('s' || source, '')) >= 5
), done AS (
  SELECT r, sum((k <> '')::INT)::BIGINT AS n_lines, sum((b.k IS NOT NULL)::INT)::BIGINT AS n_removed,
         string_agg(line, chr(10) ORDER BY n) FILTER (b.k IS NULL) AS cleaned
  FROM keyed LEFT JOIN bad b USING (k) GROUP BY r
)
SELECT doc_id, n_lines, n_removed, CASE WHEN n_removed = 0 THEN text ELSE coalesce(cleaned, '') END AS text
FROM docs JOIN done USING (r)
"""

COMPONENTS = """
, reach AS (
  SELECT a AS node, a AS other FROM link
  UNION
  SELECT reach.node, link.b FROM reach JOIN link ON reach.other = link.a
), component AS (
  SELECT node, min(other) AS root FROM reach GROUP BY node
)
"""

VECTORS = rf"""
WITH RECURSIVE fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y
  ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.95
)
{COMPONENTS}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(root, vec_id), vec_id) AS component_id,
       coalesce(least(root, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN component ON node = vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = vec_id
"""

NEAR = rf"""
WITH RECURSIVE texts AS (
  SELECT text, min(doc_id) AS t FROM documents WHERE regexp_matches(text, '{WORD}') GROUP BY text
), split AS (
  SELECT t, regexp_extract_all(text, '{WORD}') AS w FROM texts
), shingle AS (
  SELECT t, list_slice(w, i, i + 4) AS s, count(*) AS n
  FROM (SELECT t, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split) GROUP BY ALL
), size AS (
  SELECT t, sum(n) AS n FROM shingle GROUP BY t
), shared AS (
  SELECT x.t AS a, y.t AS b, sum(least(x.n, y.n)) AS n FROM shingle x JOIN shingle y ON x.s = y.s AND x.t <> y.t GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN size p ON p.t = a JOIN size q ON q.t = b WHERE shared.n >= 0.8 * (p.n + q.n - shared.n)
)
{COMPONENTS}
SELECT doc_id, coalesce(least(root, t), t, doc_id) AS class_id, doc_id = coalesce(least(root, t), t, doc_id) AS kept
FROM documents LEFT JOIN texts USING (text) LEFT JOIN component ON node = t
"""

WINDOWS = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), win AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)
), late AS (
  SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win)
  WHERE first < coalesce(doc_id, 9223372036854775807)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM late
), word AS (
  SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM split
), left_words AS (
  SELECT word.r, string_agg(x, ' ' ORDER BY word.i) AS kept, count(*) AS n
  FROM word ANTI JOIN gone ON word.r = gone.r AND word.i = gone.i GROUP BY word.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN left_words USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": MIXING,
    "op6_vector_dedup": VECTORS,
    "op7_quality_rules": QUALITY,
    "op8_line_dedup": LINES,
    "op10_minhash": NEAR,
    "op11_window_dedup": WINDOWS,
}
