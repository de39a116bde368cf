"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER = "".join(map(chr, range(65, 91)))
_WORDS = (
    rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_starts AS (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM item_starts),
doc_starts AS (
  SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM windows) z),
hits AS (
  SELECT t.doc_id, t.s, t.n, windows.item_id FROM (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM doc_starts) t
  JOIN windows ON windows.k = t.k AND windows.n = t.n),
places AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits),
words_hit AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

CAPTURES = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, sha256(h) AS digest, strlen(h)::BIGINT AS n,
  CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY sha256(h)) END AS least FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least <> page_id THEN least END AS refers_to, regexp_replace(url, '[\r\n]', '', 'g') AS url FROM d"""

SEARCH = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS t FROM benchmark),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
terms AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS wt FROM tf, totals GROUP BY t, n_docs),
lengths AS (SELECT doc_id, 10 + (90 * len(w)::BIGINT * n_docs) // n_words AS m FROM d, totals WHERE len(w) > 0),
scores AS (
  SELECT item_id, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN terms USING (t) JOIN lengths USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

# CRC-32 by its table of 256, made from the polynomial; a feature's bytes are read from its hexadecimal form.
RESAMPLING = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS c
  FROM range(256) z(b)),
d AS (SELECT 's' AS side, doc_id, {_WORDS} AS w FROM documents UNION ALL SELECT 't', NULL, {_WORDS} FROM benchmark),
starts AS (SELECT side, doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (VALUES (1), (2), (3)) z(k)),
features AS (SELECT side, doc_id, array_to_string(w[i : i + k - 1], ' ') AS f, count(*) AS n FROM starts GROUP BY ALL),
names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
buckets AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i : i + 1])::BIGINT)),
    lambda x, y: xor(x >> 8, c[(xor(x, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM names, crc_table),
counted AS (SELECT *, n AS times FROM features JOIN buckets USING (f)),
totals AS (SELECT coalesce(sum(times) FILTER (side = 's'), 0) AS s, coalesce(sum(times) FILTER (side = 't'), 0) AS t FROM counted),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(sum(times) FILTER (side = 't'), 0) + 1)::DOUBLE * (any_value(totals.s) + 10000)::DOUBLE
    / ((coalesce(sum(times) FILTER (side = 's'), 0) + 1)::DOUBLE * (any_value(totals.t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counted, totals GROUP BY bucket),
weights AS (SELECT doc_id, sum(times)::BIGINT AS n_features, sum(times * gain)::BIGINT AS weight FROM counted JOIN gains USING (bucket)
  WHERE side = 's' GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id) WHERE side = 's'),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 5 * count(*) OVER () // 100 AS k FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN r <= k THEN r END::BIGINT AS rank, n_words::BIGINT AS n_words FROM scored LEFT JOIN ranked USING (doc_id)"""

LLM_SQL: dict[str, str] = {
    "op3_decontamination": CONTAMINATION, "op6_warc": CAPTURES, "op11_resampling": RESAMPLING, "op12_search": SEARCH,
}
