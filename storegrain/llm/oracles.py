"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), grams AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), repeated AS (
  SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), f AS (
  SELECT d.rid, d.doc_id, d.source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid)
), r AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeated,
    10 * n_symbols > n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines,
    word_chars < 3 * n_words OR word_chars > 12 * n_words AS word_size
  FROM f
), long_form AS (
  UNPIVOT (SELECT source, short::INT AS short, repeated::INT AS repeated, symbols::INT AS symbols,
    lines::INT AS lines, word_size::INT AS word_size FROM r WHERE source IS NOT NULL)
  ON short, repeated, symbols, lines, word_size INTO NAME rule VALUE bad
), hosts AS (
  SELECT rule, source, sum(bad)::DOUBLE AS k, count(*)::DOUBLE AS n FROM long_form GROUP BY ALL
), moments AS (
  SELECT rule, sum(k) / sum(n) AS mean, coalesce(var_samp(k / n), 0) AS spread, avg(1 / n) AS chance
  FROM hosts GROUP BY rule
), priors AS (
  SELECT rule, mean, CASE WHEN spread - mean * (1 - mean) * chance > 0
    THEN least(greatest(mean * (1 - mean) / (spread - mean * (1 - mean) * chance) - 1, 10), 1000)
    ELSE 1000 END AS strength
  FROM moments
), failed_hosts AS (
  SELECT DISTINCT source FROM hosts JOIN priors USING (rule)
  WHERE (k + mean * strength) / (n + strength) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  short OR repeated AS base_failed,
  NOT (short OR repeated) AND failed_hosts.source IS NULL AS kept,
  failed_hosts.source IS NOT NULL AS host_failed
FROM r LEFT JOIN failed_hosts ON r.source = failed_hosts.source
"""

OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark
), w AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT item_id, words, least(10, len(words)) AS size,
          unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i
        FROM b WHERE len(words) > 0)
), spots AS (
  SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS i
  FROM d, (SELECT DISTINCT size FROM w) WHERE len(words) >= size
), hits AS (
  SELECT rid, i, spots.size AS size, item_id
  FROM spots JOIN w ON w.size = spots.size AND w.win = array_to_string(words[i:i + spots.size - 1], ' ')
), marked AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM hits)) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN named USING (rid)
"""

OP11 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
), r AS (
  SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page_id DESC NULLS LAST) AS place,
    first(page_id) OVER (PARTITION BY digest ORDER BY page_id DESC NULLS LAST) AS top
  FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(digest, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN top END AS refers_to
FROM r
"""

OP12 = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), b AS (
  SELECT list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark
), in_docs AS (
  SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(words) AS word FROM d) GROUP BY rid, word
), in_target AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY word
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(encode(word))) // 2),
      lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
    lambda c, byte: xor(c >> 8, steps[(xor(c, byte) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM in_docs UNION SELECT word FROM in_target), crc_table
), counts AS (
  SELECT bucket, sum(s) AS s, sum(t) AS t
  FROM (SELECT word, n AS s, 0 AS t FROM in_docs UNION ALL SELECT word, 0, n FROM in_target) JOIN hashed USING (word)
  GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (sum(s) OVER () ::DOUBLE + 10000)
    / ((s::DOUBLE + 1) * (sum(t) OVER () ::DOUBLE + 10000))))::BIGINT AS gain
  FROM counts
), weights AS (
  SELECT rid, sum(n * gain)::BIGINT AS weight FROM in_docs JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY rid
), scored AS (
  SELECT rid, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (rid)
), large AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, 10 * count(*) OVER () // 100 AS k
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank
FROM scored LEFT JOIN large USING (rid)
"""
