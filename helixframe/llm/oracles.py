"""SQL with the same rows as the queries, for those that SQL can express on whole tables.

Tokenisation, 64-bit hashes of shingles, rolling hashes and linked findings are
beyond it; their queries are tested against brute force instead.
"""

from __future__ import annotations

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MD5 = "md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, ''))"

SQL = {
    "op1_topk_search": """
WITH c AS (SELECT vec_id, array_to_string(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS code
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, hamming(q.code, c.code) AS distance FROM c q, c WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM d) WHERE r <= 10
""",
    "op6_mixing": f"""
WITH sized AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                              CAST('0x' || substr({_MD5}, 1, 9) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
b AS (SELECT *, greatest(0, target - copies * source_size) AS budget FROM p),
cells AS (SELECT source, hash, sum(size) AS words FROM sized GROUP BY source, hash),
u AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash) AS upto FROM cells),
e AS (SELECT b.source, min(hash) AS hash, arg_min(upto, hash) AS upto, arg_min(words, hash) AS words, any_value(budget) AS budget
      FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source WHERE upto >= budget GROUP BY b.source),
r AS (SELECT source, hash + CASE WHEN upto - budget < budget - (upto - words) THEN 1 ELSE 0 END AS threshold FROM e),
x AS (SELECT d.doc_id, d.size, d.source, b.source_size, b.target, b.copies + CASE WHEN d.hash < coalesce(r.threshold, 0) THEN 1 ELSE 0 END AS copies
      FROM sized d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM x
""",
    "op7_sharding": f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes, CAST('0x' || substr({_MD5}, 1, 10) AS BIGINT) AS key FROM documents),
p AS (SELECT d.*, depth, key >> (40 - depth) AS prefix FROM d, (SELECT unnest(range(0, 41)) AS depth)),
s AS (SELECT *, sum(bytes) OVER g AS shard_bytes, count(*) OVER g AS shard_rows FROM p WINDOW g AS (PARTITION BY depth, prefix)),
f AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY depth) AS first FROM s WHERE shard_bytes <= 262144 OR shard_rows = 1 OR depth = 40)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE to_base(prefix, 2, CAST(depth AS INTEGER)) END AS shard, CAST(depth AS INTEGER) AS depth,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows FROM f WHERE first = 1
""",
    "op9_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT n, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM l),
h AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id) OR count(doc_id) BETWEEN 1 AND count(*) - 1),
m AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id IS DISTINCT FROM h.first_id AS cut FROM k LEFT JOIN h ON k.key = h.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(CASE WHEN cut THEN 1 END) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT cut), '')) AS kept_sha256 FROM m GROUP BY n
""",
}


_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SQL["op12_lexical_search"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}') AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM d WHERE len(terms) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark),
t AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n
                   FROM (SELECT r, doc_id, unnest(terms) AS term, len(terms) AS n FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM t, s GROUP BY term),
f AS (SELECT t.r, t.doc_id, t.term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * n_docs) // CAST(n_terms AS BIGINT))))) AS part FROM t JOIN w ON t.term = w.term, s),
h AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(part) AS BIGINT) AS score FROM f JOIN q ON f.term = q.term GROUP BY item_id, r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM h WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
