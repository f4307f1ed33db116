"""DuckDB SQL for the quality cascade, the resampling and the interval join."""

from __future__ import annotations

# crc32 of a text's UTF-8 bytes as an expression; t is a column of the 256 table entries
_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT)) AS t"


def crc32(text: str) -> str:
    bytes_ = f"list_transform(range(1, 2 * strlen({text}), 2), lambda k: CAST('0x' || substr(hex(encode({text})), k, 2) AS BIGINT))"
    return f"xor(list_reduce({bytes_}, lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


QUALITY_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
grams AS (SELECT r, unnest(range(1, len(w) - 3)) AS p, w FROM w WHERE len(w) >= 5),
named AS (SELECT r, p, array_to_string(w[p : p + 4], ' ') AS g FROM grams),
twice AS (SELECT r, p FROM named QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, text, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.1::DOUBLE * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_dup_lines > 0.3::DOUBLE * n_lines AND n_dup_lines > 2)
    OR length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > 0.5::DOUBLE * word_chars OR length(regexp_replace(text, '[\p{L}\p{M}\x20\x09-\x0D]+', '', 'g')) > 0.5::DOUBLE * word_chars
    OR length(regexp_replace(text, '[^!?]+', '', 'g')) > 0.3::DOUBLE * n_words) AS kept
FROM judged
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
RESAMPLE_SQL = f"""
WITH crc AS (SELECT {_TABLE}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_TERMS}) AS word FROM benchmark),
words AS (SELECT word, {crc32("word")} % 10000 AS b FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT b, count(*) AS s FROM dw JOIN words USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN words USING (word) GROUP BY b),
g AS (
  SELECT word, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS gain
  FROM words LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
sums AS (SELECT r, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dw JOIN g USING (word) GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN sums USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS p, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS k FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND p <= k THEN p END AS rank FROM placed
"""

INTERVALS_SQL = f"""
WITH crc AS (SELECT {_TABLE}),
c AS (SELECT client_id, epoch_us(ts) AS us, coalesce(kind = 'error', false) AS f FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT *, CAST(coalesce(us - lag(us) OVER w > 900000000, true) AS INTEGER) AS n FROM c WINDOW w AS (PARTITION BY client_id ORDER BY us)),
k AS (SELECT *, sum(n) OVER (PARTITION BY client_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM b),
x AS (SELECT client_id, k, min(us) AS first, max(us * 2 + f::BIGINT) AS last FROM k GROUP BY ALL),
spans AS (
  SELECT client_id, floor_div(first) AS s, CASE WHEN last % 2 = 1 THEN 9223372036854775807 ELSE floor_div(last // 2) END AS e, {crc32("CAST(first AS VARCHAR)")} AS crc
  FROM x, crc),
ends AS (SELECT sale_id, max(epoch_us(shipped_at)) AS shipped FROM sale_lines GROUP BY sale_id),
sold AS (
  SELECT sale_id, client_id, floor_div(epoch_us(sold_at)) AS s, CASE WHEN status = 'open' THEN 9223372036854775807 ELSE floor_div(greatest(epoch_us(sold_at), coalesce(shipped, epoch_us(sold_at)))) END AS e
  FROM sales LEFT JOIN ends USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (
  SELECT a.sale_id, b.crc, CASE WHEN a.s < b.s THEN 0 WHEN a.s = b.s THEN 3 ELSE 6 END + CASE WHEN a.e < b.e THEN 0 WHEN a.e = b.e THEN 1 ELSE 2 END AS rel,
    CASE WHEN a.e = 9223372036854775807 AND b.e = a.e THEN NULL ELSE least(a.e, b.e) - greatest(a.s, b.s) + 1 END AS shared
  FROM sold a JOIN spans b USING (client_id) WHERE a.s <= b.e AND b.s <= a.e)
SELECT sale_id, ['overlaps', 'finished_by', 'contains', 'starts', 'equals', 'started_by', 'during', 'finishes', 'overlapped_by'][rel + 1] AS relation,
  count(*) AS n_pairs, CAST(sum(shared) AS BIGINT) AS overlap_slots, CAST(sum(crc) AS BIGINT) AS sessions_crc
FROM p GROUP BY ALL
"""
# whole slots of six hours, floored, times before 1970 too
for _call in ("floor_div(first)", "floor_div(last // 2)", "floor_div(epoch_us(sold_at))", "floor_div(greatest(epoch_us(sold_at), coalesce(shipped, epoch_us(sold_at))))"):
    _x = _call[len("floor_div(") : -1]
    INTERVALS_SQL = INTERVALS_SQL.replace(_call, f"(({_x}) - ((({_x}) % 21600000000 + 21600000000) % 21600000000)) // 21600000000")
