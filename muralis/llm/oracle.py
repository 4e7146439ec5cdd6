"""DuckDB SQL of the corpus queries that SQL can express."""

_LOW = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = "list_filter(regexp_split_to_array(" + _LOW.format(t="coalesce(text, '')") + ", '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, unnest(list_transform(range(greatest(len(w) - 12, 1)), lambda i: array_to_string(list_slice(w, i + 1, i + 13), ' '))) AS win, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
u AS (SELECT DISTINCT win, n FROM bw),
sizes AS (SELECT DISTINCT n FROM u),
dw AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s + 1, s + n), ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS s FROM d, sizes)),
hits AS (SELECT doc_id, s, dw.n, dw.win FROM dw JOIN u ON dw.win = u.win AND dw.n = u.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits JOIN bw ON hits.win = bw.win AND hits.n = bw.n GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

QUALITY = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
tri AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 0))) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM lines WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS k FROM f GROUP BY source),
tot AS (SELECT sum(n) AS n, sum(k) / sum(n) AS mean, count(*) AS hosts, sum(n * n) AS n2, sum(k * k / n) AS s FROM h),
pri AS (SELECT mean, CASE WHEN hosts > 1 AND mean > 0 AND mean < 1 THEN (s - n * mean * mean - (hosts - 1) * mean * (1 - mean)) / greatest(n - n2 / n - (hosts - 1), 1e-9::DOUBLE) ELSE 0 END AS between_ FROM tot),
wt AS (SELECT mean, CASE WHEN between_ > 0 THEN greatest(2e0, mean * (1 - mean) / between_ - 1) ELSE 1e9::DOUBLE END AS weight FROM pri),
bad AS (SELECT source, (k + mean * weight) / (n + weight) > 0.8e0 AS rejected FROM h, wt)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""

PASSAGES = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 35), ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 34, 0))) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
cov AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM rep)),
gone AS (SELECT doc_id, list(p) AS ps FROM cov GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL = {"op5_decontamination": DECONTAMINATION, "op8_quality_rules": QUALITY, "op9_repeated_passages": PASSAGES}
