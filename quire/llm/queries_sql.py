"""DuckDB SQL of those corpus queries that SQL can express."""

from __future__ import annotations

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# CRC-32 of a string's UTF-8 bytes: the table of the reversed polynomial from its rule, then a step a byte.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc)"""


def crc32(text: str) -> str:
    byte = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex({text}), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {byte}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS} AS w, least(len(w), 10) AS n FROM benchmark),
item_runs AS (SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS run FROM b WHERE n > 0),
lengths AS (SELECT DISTINCT n FROM item_runs),
lists AS (SELECT r, n, list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) AS runs FROM d, lengths WHERE len(w) >= n),
doc_runs AS (SELECT r, n, unnest(runs) AS run, generate_subscripts(runs, 1) AS spot FROM lists),
hits AS (SELECT r, n, spot, item FROM doc_runs JOIN item_runs USING (n, run)),
spots AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(spot, spot + n)) AS p FROM hits) GROUP BY r),
ids AS (SELECT r, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN spots USING (r) LEFT JOIN ids USING (r)"""

OP12 = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({FOLDED}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT run, id || ':' || run AS key, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {crc32("key")} AS h FROM counted, crc_table),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1),
v AS (SELECT word, n FROM words WHERE length(word) >= 7 AND n >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v),
wild AS (SELECT word, n, p, substr(word, 1, p - 1) AS head, substr(word, p + 1) AS tail FROM places),
deleted AS (SELECT DISTINCT word, n, head || tail AS less FROM wild),
pairs AS (SELECT a.word AS word, a.n AS n, b.word AS near, b.n AS near_n FROM wild a JOIN wild b USING (p, head, tail) WHERE a.word <> b.word
  UNION ALL SELECT d.word, d.n, v.word, v.n FROM deleted d JOIN v ON d.less = v.word UNION ALL SELECT v.word, v.n, d.word, d.n FROM deleted d JOIN v ON d.less = v.word),
ranked AS (SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM pairs),
best AS (SELECT word, n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM ranked WHERE k = 1),
known AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, form, form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS last, 0 AS steps FROM known UNION ALL SELECT walk.word, known.form, steps + 1 FROM walk JOIN known ON known.word = walk.last WHERE known.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, steps) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM known JOIN roots USING (word)"""

OP13 = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT unnest({WORDS}) AS word FROM benchmark),
uses AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY ALL),
vocabulary AS (SELECT word FROM uses UNION SELECT word FROM b),
buckets AS (SELECT word, {crc32("word")} % 10000 AS bucket FROM vocabulary, crc_table),
s AS (SELECT bucket, sum(n) AS s FROM uses JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS all_t),
gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM uses JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY r),
noise AS (SELECT r, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN weights USING (r)),
scored AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM noise),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= floor(10 * n / 100) THEN k END AS rank FROM scored LEFT JOIN ranked USING (r)"""

ORACLE_SQL = {"op11_decontamination": OP11, "op12_spelling": OP12, "op13_resampling": OP13}
