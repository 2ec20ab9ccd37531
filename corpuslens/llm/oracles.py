"""DuckDB SQL for the operators that it can express; plain definitions, fit for the small tables only."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every document met with every window of every item.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents), b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
s AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0), i AS (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM s),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, j, j + k - 1), ' ') AS w FROM i), ks AS (SELECT DISTINCT k FROM win),
p AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM d, ks), hit AS (SELECT doc_id, j, k, item_id FROM (SELECT doc_id, j, k, array_to_string(list_slice(ws, j, j + k - 1), ' ') AS w FROM p) JOIN win USING (k, w)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS q FROM hit) GROUP BY doc_id),
o AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)
"""

#: Every 100-byte string (as 200 hex digits) but the first of its kind; overlapping ones are islands.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS j, unnest(list_transform(range(0, length(h) // 2 - 99), lambda i: md5(substr(h, 2 * i + 1, 200)))) AS m FROM d WHERE length(h) >= 200),
w AS (SELECT doc_id, j, row_number() OVER (PARTITION BY m ORDER BY doc_id, j) AS k FROM p), r AS (SELECT doc_id, j FROM w WHERE k > 1),
g AS (SELECT doc_id, j, CASE WHEN j <= lag(j) OVER o + 100 THEN 0 ELSE 1 END AS opens FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
n AS (SELECT doc_id, j, sum(opens) OVER (PARTITION BY doc_id ORDER BY j) AS island FROM g), s AS (SELECT doc_id, island, min(j) AS a, max(j) + 100 AS b FROM n GROUP BY ALL),
c AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last FROM s),
k AS (SELECT c.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * last + 1 AS BIGINT), CAST(2 * (a - last) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept FROM c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


#: What one round of clustering computes: squared distances to all centroids, the nearest one, and its new place.
_NEAR = """{a} AS MATERIALIZED (SELECT row_id, min({{'d': d, 'c': c}}) AS b FROM (
  SELECT row_id, c, list_sum(list_transform(list_zip(kept.v, {c}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM kept, {c}) GROUP BY row_id)"""
_MOVE = """{m} AS MATERIALIZED (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
  SELECT {a}.b.c AS c, i, sum(kept.v[i]) AS s, count(*) AS n FROM {a} JOIN kept USING (row_id), range(1, 65) AS r(i)
  GROUP BY ALL) GROUP BY c),
{next} AS MATERIALIZED (SELECT c, coalesce({m}.v, {c}.v) AS v FROM {c} LEFT JOIN {m} USING (c))"""

#: Three rounds written out: every vector meets every centroid in each.
SORT_MEANS = (
    """
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id,
  list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (
  SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 16)),
"""
    + ",\n".join(_NEAR.format(a=f"a{i}", c=f"c{i}") + ",\n" + _MOVE.format(a=f"a{i}", m=f"m{i}", c=f"c{i}", next=f"c{i + 1}") for i in range(3))
    + ",\n"
    + _NEAR.format(a="a3", c="c3")
    + """,
f AS (SELECT vec_id, a3.b.c AS c, CAST(a3.b.d AS BIGINT) AS distance FROM a3 JOIN kept USING (row_id))
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM f JOIN c3 USING (c)
"""
)
