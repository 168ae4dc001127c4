"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), window_of AS (
  SELECT DISTINCT item_id, w[i : i + least(len(w), 13) - 1] AS ws, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item WHERE len(w) > 0)
), doc_window AS (
  SELECT doc_id, n, i, w[i : i + n - 1] AS ws
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc, (SELECT DISTINCT n FROM window_of) WHERE len(w) >= n)
), hit AS (
  SELECT d.doc_id, d.i, d.n, b.item_id FROM doc_window d JOIN window_of b ON d.n = b.n AND d.ws = b.ws
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""


OP6 = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, w[i : i + least(len(w), 5) - 1] AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM doc WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN size USING (doc_id)
"""


OP7 = """
WITH doc AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT), 48, '0') AS address FROM documents
), prefix AS (
  SELECT depth, left(address, depth) AS shard_id, sum(n_bytes) AS bytes, count(*) AS n
  FROM doc, range(0, 49) r(depth) GROUP BY ALL
), shard AS (
  SELECT d.doc_id, d.n_bytes, p.shard_id, p.depth, p.bytes,
    row_number() OVER (PARTITION BY d.doc_id ORDER BY p.depth) AS place
  FROM doc d JOIN prefix p ON p.shard_id = left(d.address, p.depth) WHERE p.bytes <= 67108864 OR p.n = 1
)
SELECT doc_id, n_bytes, shard_id, depth::INTEGER AS shard_depth, bytes > 67108864 AS oversized FROM shard WHERE place = 1
"""

OP9 = """
WITH code AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS c FROM embeddings WHERE len(embedding) = 64
), pair AS (
  SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id,
    len(list_filter(list_zip(q.c, n.c), lambda z: z[1] <> z[2]))::BIGINT AS distance
  FROM code q, code n WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pair
) WHERE rank <= 10
"""


def _lloyd(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Lloyd's rounds, one pair of steps after the other; vectors and centroids as rows of components."""
    steps = [
        f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS c
  FROM embeddings WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
), v AS MATERIALIZED (
  SELECT r, unnest(range(1, {dims + 1})) AS d, unnest(c) AS x FROM kept
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, c) - 1 AS k, c
  FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, c FROM kept) QUALIFY k < {k}
), m0 AS MATERIALIZED (
  SELECT k, unnest(range(1, {dims + 1})) AS d, unnest(c) AS x FROM c0
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, k, s FROM (SELECT r, k, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS s FROM v JOIN m{i} m USING (d) GROUP BY r, k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY s, k) = 1
)""")
        if i < rounds:
            steps.append(f"""m{i + 1} AS MATERIALIZED (
  SELECT k, d, coalesce((s - ((s % n) + n) % n) // n, m{i}.x) AS x FROM m{i} LEFT JOIN (
    SELECT k, d, sum(x)::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (r) GROUP BY k, d) USING (k, d)
)""")
    return (
        ", ".join(steps)
        + f"""
SELECT vec_id, a.k::INTEGER AS cluster, s AS distance, sum(s) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia,
  sum(s) OVER ()::BIGINT AS inertia, sha AS centroid_sha256
FROM a{rounds} a JOIN kept USING (r)
JOIN (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS sha FROM m{rounds} GROUP BY k) USING (k)
"""
    )


#: unsigned crc32 of a decimal number, bit by bit: each character is taken in, then eight bits are shifted out.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

OP13 = f"""
WITH own AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, {CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)
), turns AS (
  SELECT c.conv_id, 0 AS part, o.p, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.p <= h
  UNION ALL
  SELECT c.conv_id, 1, o.p, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.p > h
), path AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS n,
    string_agg(sha256(length(role)::VARCHAR || ':' || role || text), '') OVER w AS node
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)
), member AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, 0 AS n, '' AS node FROM conv UNION ALL SELECT conv_id, depth, n, sha256(node) FROM path
), node AS MATERIALIZED (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM member GROUP BY node, depth
), edge AS MATERIALIZED (
  SELECT x.node, x.depth, x.conv_id, x.n_convs, x.n, p.node AS parent, p.conv_id AS parent_conv_id
  FROM node x LEFT JOIN member m ON m.conv_id = x.conv_id AND m.depth = x.depth - 1 LEFT JOIN node p ON p.node = m.node
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM edge WHERE parent IS NOT NULL GROUP BY parent
), total AS (
  SELECT a.node, sum((x.n_convs - 1) * x.n)::BIGINT AS saved_tokens, count(*) FILTER (c.node IS NULL) AS n_leaves
  FROM edge x LEFT JOIN children c ON c.node = x.node
  JOIN member a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY a.node
), ends AS (
  SELECT arg_max(node, depth) AS node, conv_id FROM member GROUP BY conv_id
), ended AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM ends GROUP BY node
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens,
  coalesce(sha, sha256('')) AS ends_sha256
FROM edge LEFT JOIN children USING (node) JOIN total USING (node) LEFT JOIN ended USING (node)
"""


def llm_oracle() -> dict[str, str]:
    return {
        "op6_near_duplicates": OP6,
        "op7_shards": OP7,
        "op9_nearest_codes": OP9,
        "op10_contamination": OP10,
        "op12_centroids": _lloyd(),
        "op13_prefix_trie": OP13,
    }
