"""DuckDB SQL for the operators that SQL can express; the others have brute-force tests."""

OP1 = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
       least(vec_id, coalesce(low.b, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""

OP2 = r"""
WITH counted AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM counted WHERE len(w) > 2)
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM windows, (VALUES (0), (1), (2)) AS step(d) WHERE n > 1 GROUP BY doc_id
), f AS (
  SELECT c.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_marks,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM counted c LEFT JOIN covered USING (doc_id)
), g AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         {'symbols': n_symbols / greatest(n_words, 1), 'marks': n_marks / greatest(n_words, 1),
          'dup_lines': n_dup_lines / greatest(n_lines, 1), 'repeats': n_repeat_words / greatest(n_words, 1),
          'word_length': word_chars / greatest(n_words, 1)} AS rates
  FROM f
), grid(rule, cutoff) AS (VALUES
  ('symbols', 0.05::DOUBLE), ('symbols', 0.1), ('symbols', 0.2), ('symbols', 0.3), ('symbols', 0.5), ('symbols', 1.0),
  ('marks', 0.05), ('marks', 0.1), ('marks', 0.2), ('marks', 0.3), ('marks', 0.5), ('marks', 1.0),
  ('dup_lines', 0.1), ('dup_lines', 0.2), ('dup_lines', 0.3), ('dup_lines', 0.5),
  ('repeats', 0.1), ('repeats', 0.2), ('repeats', 0.3), ('repeats', 0.4),
  ('word_length', 8.0), ('word_length', 9.0), ('word_length', 10.0), ('word_length', 12.0)
), rated AS (
  SELECT doc_id, lang, rule, cutoff, base_failed,
         CASE rule WHEN 'symbols' THEN rates.symbols WHEN 'marks' THEN rates.marks WHEN 'dup_lines' THEN rates.dup_lines
                   WHEN 'repeats' THEN rates.repeats ELSE rates.word_length END > cutoff AS hit
  FROM g, grid
), tests AS (
  SELECT lang, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND hit) AS k,
         count(*) FILTER (NOT good AND hit) AS bad
  FROM rated JOIN (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
  WHERE NOT base_failed GROUP BY lang, rule, cutoff
), proven AS (  -- the cutoffs of a rule in a fixed sequence, the most lenient first, up to the first that fails
  SELECT *, bad - 20 * k AS gain, bool_and(
    k < n * 0.01 AND
    (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))
     FROM (SELECT unnest(range(0, k + 1)) AS i)) <= 0.05 / (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM tests)))
    OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS certified
  FROM tests
), chosen AS (
  SELECT lang, rule, cutoff FROM proven WHERE certified AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, cutoff DESC) = 1
), failed AS (
  SELECT DISTINCT doc_id FROM rated r JOIN chosen c
    ON r.lang IS NOT DISTINCT FROM c.lang AND r.rule = c.rule AND r.cutoff = c.cutoff WHERE hit
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept
FROM g
"""

OP6 = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                               ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
)
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) = 1
"""

OP7 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS low, strlen(html) >= 100 AS big FROM p)
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN big AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN big AND page_id <> low THEN low END AS refers_to, NULL::VARCHAR AS error
FROM m
"""

OP11 = r"""
WITH bits AS (  -- CRC-32 of the bytes 0 to 255, reflected polynomial EDB88320
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab
  FROM range(256) r(i)
), corpus AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), target AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), words AS (
  SELECT word, hex(encode(word)) AS h
  FROM (SELECT unnest(w) AS word FROM corpus UNION SELECT unnest(w) FROM target)
), hashed AS (
  SELECT word, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, [('0x' || substr(h, 2 * i - 1, 2))::BIGINT FOR i IN range(1, length(h) // 2 + 1)]),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM words, bits
), counts AS (SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM corpus) JOIN hashed USING (word) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS n FROM counts GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS word FROM target) JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket), totals
), weighed AS (SELECT doc_id, sum(n * g)::BIGINT AS weight FROM counts JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                    / 4294967296::DOUBLE)))::BIGINT AS score
  FROM corpus LEFT JOIN weighed USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         sha256('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), sorted AS (  -- sources in the order in which their targets stop
  SELECT *, row_number() OVER o AS k,
         3 * sum(source_size) OVER () - 2 * (sum(2 * source_size) OVER o - 2 * source_size) AS num,
         2 * (sum(w) OVER () - sum(w) OVER o + w) AS den
  FROM src WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), level AS (SELECT num, den FROM sorted WHERE w * num <= 2 * source_size * den ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN w * l.num > 2 * source_size * l.den THEN (2 * source_size)::DOUBLE ELSE (w * l.num)::DOUBLE / l.den::DOUBLE END AS target,
         CASE WHEN w * l.num > 2 * source_size * l.den THEN 2 * source_size ELSE w * l.num // l.den END AS words
  FROM sorted, level l
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d
)
SELECT doc_id, size, t.source, source_size, target,
       (least(size, greatest(words - start, 0)) + least(size, greatest(words - source_size - start, 0)))::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""

ORACLES = {
    "op1_embedding_near_dedup": OP1,
    "op2_quality_rules": OP2,
    "op6_url_filter": OP6,
    "op7_warc_archive": OP7,
    "op11_importance_resampling": OP11,
    "op12_source_mixing": OP12,
}
