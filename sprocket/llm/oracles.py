"""DuckDB SQL for the queries that SQL can express."""

OP2 = """
WITH b AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM b GROUP BY d)
SELECT b.page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(b.d, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT) >> s) % 32 AS BIGINT), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN f.first = b.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first = b.page_id THEN NULL ELSE f.first END AS refers_to, TRUE AS valid
FROM b JOIN f USING (d)
"""

OP3 = r"""
WITH h AS (SELECT DISTINCT regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.|\.$', '') AS host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS k FROM pages),
e AS (SELECT DISTINCT regexp_replace(lower(pattern), '^www\.', '') AS pattern, list, action, since FROM (VALUES $EVENTS) v(pattern, list, action, since)
  UNION SELECT host, 'watch', 'add', epoch_ms(1704067200000 + k % 300 * 86400000) FROM h WHERE k % 3 = 0
  UNION SELECT host, 'watch', 'remove', epoch_ms(1704067200000 + (k % 300 + 20 + k % 7) * 86400000) FROM h WHERE k % 3 = 0),
one AS (SELECT pattern, list, since, NOT bool_or(action = 'remove') AS state FROM e GROUP BY ALL),
prior AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY pattern, list ORDER BY since), FALSE) AS was FROM one),
spans AS (SELECT pattern, list, state, since AS valid_from, lead(since) OVER (PARTITION BY pattern, list ORDER BY since) AS valid_to FROM prior WHERE state <> was),
c AS (SELECT page_id, url, 1704067200 + (page_id * 86477) % 31536000 AS fetched_s,
  regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.|\.$', '') AS host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
hits AS (SELECT c.page_id, s.list, s.pattern FROM c JOIN spans s ON s.state
  AND (c.host = split_part(s.pattern, '/', 1) OR ends_with(c.host, '.' || split_part(s.pattern, '/', 1)))
  AND (NOT contains(s.pattern, '/') OR split_part(s.pattern, '/', 2) = c.parts[1])
  AND epoch(s.valid_from) <= c.fetched_s AND (s.valid_to IS NULL OR c.fetched_s < epoch(s.valid_to))),
g AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, string_agg(DISTINCT pattern, ',' ORDER BY pattern) AS patterns FROM hits GROUP BY page_id)
SELECT c.page_id, c.url, CAST(c.fetched_s AS BIGINT) AS fetched_s, coalesce(g.lists, '') AS lists, coalesce(g.patterns, '') AS patterns, g.page_id IS NOT NULL AS blocked
FROM c LEFT JOIN g USING (page_id)
"""

#: (metric, whether its lower fence holds, the least spread from the medians of words and lines)
_METRICS = (
    ("mean_len", True, "CAST(pow(2, greatest(length(bin(mean_len_q50)) - 6, 0)) AS BIGINT)"),
    ("symbol_rate", False, "greatest(1000 // words_q50, 1)"),
    ("dup_line_rate", False, "greatest(1000 // lines_q50, 1)"),
    ("repeat_rate", False, "greatest(6000 // words_q50, 1)"),
)
_ALL = ("mean_len", "symbol_rate", "dup_line_rate", "repeat_rate", "words", "lines")

_RATES = "(100 * word_chars) // greatest(n_words, 1) AS mean_len, (1000 * n_symbols) // greatest(n_words, 1) AS symbol_rate, (1000 * n_dup_lines) // greatest(n_lines, 1) AS dup_line_rate, (1000 * n_repeat_words) // greatest(n_words, 1) AS repeat_rate, greatest(n_words, 1) AS words, greatest(n_lines, 1) AS lines"


def _fences(name: str, keys: str) -> str:
    by = f"PARTITION BY {keys + ', ' if keys else ''}metric"
    lead = f"{keys}, " if keys else ""
    return f"""
{name}_c AS (SELECT {lead}metric, value, sum(n) AS n FROM sketch GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER ({by} ORDER BY value) AS upto, sum(n) OVER ({by}) AS total FROM {name}_c),
{name}_q AS (SELECT {lead}metric, min(value) FILTER (WHERE 100 * upto >= 10 * total) AS q10, min(value) FILTER (WHERE 100 * upto >= 50 * total) AS q50, min(value) FILTER (WHERE 100 * upto >= 90 * total) AS q90, max(total) AS n FROM {name}_r GROUP BY ALL)"""


OP10 = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM win),
again AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(again.k, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines FROM d LEFT JOIN again USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_RATES} FROM m),
long AS (SELECT lang, source, metric, v FROM (SELECT lang, source, base_failed, {", ".join(f"CAST({m} AS BIGINT) AS {m}" for m in _ALL)} FROM r) UNPIVOT (v FOR metric IN ({", ".join(_ALL)})) WHERE NOT base_failed),
sketch AS (SELECT lang, source, metric, v - v % CAST(pow(2, greatest(length(bin(v)) - 6, 0)) AS BIGINT) AS value, count(*) AS n FROM long GROUP BY ALL),
{_fences("a", "lang, source")}, {_fences("b", "lang")}, {_fences("e", "")},
pick AS (SELECT a_q.lang, a_q.source, a_q.metric, {", ".join(f"CASE WHEN a_q.n >= 100 THEN a_q.{q} WHEN b_q.n >= 100 THEN b_q.{q} ELSE e_q.{q} END AS {q}" for q in ("q10", "q50", "q90"))}
  FROM a_q LEFT JOIN b_q ON a_q.metric = b_q.metric AND a_q.lang IS NOT DISTINCT FROM b_q.lang LEFT JOIN e_q ON a_q.metric = e_q.metric),
wide AS (SELECT lang, source, {", ".join(f"max(CASE WHEN metric = '{m}' THEN {q} END) AS {m}_{q}" for m in _ALL for q in ("q10", "q50", "q90"))} FROM pick GROUP BY lang, source),
lim AS (SELECT lang, source, {", ".join(f"{m}_q10 - 8 * greatest({m}_q50 - {m}_q10, {least}) AS lo_{m}, {m}_q90 + 8 * greatest({m}_q90 - {m}_q50, {least}) AS hi_{m}" for m, _, least in _METRICS)} FROM wide)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({" OR ".join((f"{m} < lo_{m} OR " if low else "") + f"{m} > hi_{m}" for m, low, _ in _METRICS)}, FALSE) AS kept
FROM r LEFT JOIN lim ON r.lang IS NOT DISTINCT FROM lim.lang AND r.source IS NOT DISTINCT FROM lim.source
"""

#: Fixed value: the polynomial of the CRC that zip files use, 3988292384.
OP11 = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
texts AS (SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM words),
each_gram AS (SELECT side, id, g, count(*) AS k FROM grams GROUP BY ALL),
spelled AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM each_gram)),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket FROM spelled, tab),
placed AS (SELECT side, id, bucket, k FROM each_gram JOIN hashed USING (g)),
n AS (SELECT bucket, coalesce(sum(k) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (side = 'b'), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain FROM n),
sums AS (SELECT id, sum(k * gain) AS weight FROM placed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (SELECT id AS doc_id, len(w) AS n_words, CAST(3 * len(w) - least(len(w), 1) - least(len(w), 2) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM words LEFT JOIN sums USING (id) WHERE side = 'd'),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * (SELECT count(*) FROM places) // 100 THEN place END AS rank FROM scored LEFT JOIN places USING (doc_id)
"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS id, a.label = o.label AS same, CAST(list_inner_product(a.e, o.e) AS BIGINT) AS score FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
