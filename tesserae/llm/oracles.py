"""DuckDB SQL for the queries that it can express, from the operators' definitions."""

from __future__ import annotations

#: Line frequency in SQL: documents count as distinct by their sets of normalised lines.
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw FROM d),
n AS (SELECT *, list_transform(raw, lambda x: lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')))) AS lines FROM w),
g AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, k) > 1),
repeated AS (SELECT row, count(*) AS c FROM (SELECT DISTINCT row, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY row),
line AS (SELECT row, host, l, len(list_filter(string_split(l, ' '), lambda x: x <> '')) AS words, digest FROM
  (SELECT row, host, unnest(lines) AS l, list_sort(list_distinct(lines)) AS digest FROM n)),
over AS (SELECT host, l FROM line GROUP BY host, l HAVING count(DISTINCT digest) > 50),
gone AS (SELECT row, sum(words) AS c FROM line SEMI JOIN over USING (host, l) GROUP BY row),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.c, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.c, 0) AS BIGINT) AS n_removed
  FROM n LEFT JOIN repeated r USING (row) LEFT JOIN gone USING (row)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed, NOT base_failed AND n_removed <= 0.6 * n_words AS kept FROM f
"""


#: 2 ** 64, the multipliers of the round function and of its keys, and the reversed CRC-32 polynomial.
_WORD, _TIMES, _STEP, _SEED, _CRC = "18446744073709551616::UHUGEINT", (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), 0xD1B54A32D192ED03, 0x9E3779B97F4A7C15, 0xEDB88320


#: The table of a byte-wise CRC-32.
_TABLE = f"tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, {_CRC}) ELSE x // 2 END) AS c FROM range(256) g(i)))"


def _permuted(seed: int, rounds: int) -> str:
    """The permutation's rounds over w: two digits of place, each in turn changed by a hash of the other."""
    own = "doc_id, size, crc, n, a, b, round"
    sql = f"SELECT {own}, place // b AS hi, place % b AS lo FROM w WHERE open"
    word = lambda x: f"CAST(({x}) % {_WORD} AS UBIGINT)"
    for k in range(1, rounds + 1):
        key = (seed * _SEED + k * _STEP) % (1 << 64)
        of, to, base = ("lo", "hi", "a") if k % 2 else ("hi", "lo", "b")
        sql = f"SELECT *, {word(f'CAST({of} AS UHUGEINT) + {key}::UHUGEINT')} AS z FROM ({sql})"
        for shift, times in zip((30, 27), _TIMES, strict=True):
            sql = f"SELECT * REPLACE ({word(f'CAST(xor(z, z >> {shift}) AS UHUGEINT) * {times}::UHUGEINT')} AS z) FROM ({sql})"
        sql = f"SELECT * EXCLUDE (z) REPLACE (CAST(({to} + CAST(xor(z, z >> 31) % {base} AS BIGINT)) % {base} AS BIGINT) AS {to}) FROM ({sql})"
    return f"SELECT {own.removesuffix(', round')}, hi * b + lo, round + 1, hi * b + lo >= n FROM ({sql})"


def shards_sql(n_shards: int = 40, seed: int = 0, rounds: int = 6) -> str:
    """Rows by id, checksum and size, permuted until they fall below their number, then dealt in turn."""
    return f"""
WITH RECURSIVE {_TABLE},
d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
h AS (SELECT doc_id, CAST(octet_length(raw) AS BIGINT) AS bytes, hex(raw) AS x FROM d),
c AS (SELECT doc_id, bytes + 16 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(range(bytes), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda s, y: xor(s // 256, t[xor(s, y) % 256 + 1])), 4294967295) AS crc FROM h, tab),
o AS (SELECT doc_id, size, crc, CAST(row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS BIGINT) AS pos, count(*) OVER () AS n FROM c),
r AS (SELECT *, greatest(1, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1) AS a FROM o),
w AS (SELECT doc_id, size, crc, n, a, greatest(1, (n + a - 1) // a) AS b, pos AS place, 0 AS round, true AS open FROM r
 UNION ALL {_permuted(seed, rounds)})
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(place % {n_shards} AS INT) AS shard, place // {n_shards} AS slot, CAST(NULL AS INT) AS grown_shard FROM w WHERE NOT open
"""


#: Every item against every document, by the formula of the scores.
SEARCH_SQL = r"""
WITH sep AS (SELECT '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), up, low), s), lambda x: x <> '') AS w FROM documents, sep),
q AS (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
i AS (SELECT row_number() OVER () AS item, item_id, list_filter(string_split_regex(translate(text, up, low), s), lambda x: x <> '') AS w FROM q, sep),
asked AS (SELECT item, term, count(*) AS c FROM (SELECT item, unnest(w) AS term FROM i) GROUP BY ALL),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n),
part AS (SELECT row, term, tf, 75 + (25 * len(d.w) * n) // l AS m FROM tf JOIN d USING (row), total),
scored AS (SELECT item, row, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM asked JOIN df USING (term) JOIN part USING (term) GROUP BY ALL),
o AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored JOIN d USING (row) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM o JOIN i USING (item) WHERE rank <= 20
"""

#: Prefixes grouped by a digest of their turns; what lies below a node is found on the paths of nodes' smallest members.
TRIE_SQL = f"""
WITH {_TABLE},
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS x FROM o),
i AS (SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x)), lambda i: ascii(substr(x, i + 1, 1))::BIGINT)), lambda s, y: xor(s // 256, t[xor(s, y) % 256 + 1])), 4294967295) % 6 AS h FROM s, tab),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, role, text FROM (
  SELECT i.c, 0 AS own, pos, role, text FROM i JOIN o ON o.c = i.c - i.c % 100 AND pos <= h UNION ALL SELECT c, 1, pos, role, text FROM i JOIN o USING (c) WHERE pos > h)),
p AS (SELECT c, d, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d)) AS k, length(text) AS n FROM r UNION ALL SELECT c, 0, '', 0 FROM i),
up AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS pk, d = max(d) OVER (PARTITION BY c) AS last FROM p),
node AS (SELECT k, d, min(c) AS conv, any_value(pk) AS pk, count(*) AS members, (count(*) - 1) * any_value(n) AS own, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends FROM up GROUP BY k, d),
kids AS (SELECT pk AS k, count(*) AS kids FROM node WHERE d > 0 GROUP BY pk),
whole AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (k)),
below AS (SELECT p.k, count(*) FILTER (x.kids = 0) AS leaves, sum(x.own) AS saved FROM whole x JOIN p ON p.c = x.conv AND p.d <= x.d GROUP BY p.k)
SELECT w.conv AS conv_id, w.d AS depth, u.conv AS parent_conv_id, w.members AS n_convs, w.kids AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN below b USING (k) LEFT JOIN node u ON u.k = w.pk
"""
