"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations



def drawn(x: str, key: str, n: str) -> str:
    """mixing.drawn in SQL."""
    return f"(('0x' || substr(md5(({x})::VARCHAR || ':' || ({key})::VARCHAR), 1, 15))::BIGINT % ({n}))"


def sized_value(x: str) -> str:
    """merkle.sized_value in SQL."""
    return f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')"


#: crc32 of doc_id in decimal, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""

MIRROR = "CASE WHEN k >= a THEN k - a ELSE k - a + n END"
SWAP = f"((greatest(a, {MIRROR}) % 1073741789 + k % 1073741789) * (greatest(a, {MIRROR}) % 1073741789 + 29773456)) % 1073741783 % 2 = 1"

SQL = {
    "op1_mixing": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
sm AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, h) AS same FROM d),
pl AS (SELECT *, """ + drawn("coalesce(doc_id, 0)", "h + same", "(SELECT count(*) // 4096 + 1 FROM d)") + r""" AS part FROM sm),
st AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY part, doc_id NULLS FIRST, size, h, same) - size AS start FROM pl),
tot AS (SELECT source, sum(size) AS s FROM d GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM tot),
c AS (SELECT *, ((no - 1) % 3 + 1)::DOUBLE AS weight FROM w),
k AS (SELECT *, sum(s) OVER () AS alls, sum(weight) OVER () AS allw, sum(3 * s) OVER o - 3 * s AS caps, sum(weight) OVER o - weight AS wb FROM c WINDOW o AS (ORDER BY s / weight, no)),
l AS (SELECT *, (alls - caps) / (allw - wb) AS level FROM k),
f AS (SELECT arg_min(level, wb) AS lam FROM l WHERE level * weight < 3 * s),
t AS (SELECT l.source, l.no, l.s::BIGINT AS s, round(coalesce(least(3.0 * s, lam * weight), 3.0 * s), 6) AS target FROM l, f),
p AS (SELECT *, CAST(ceil(s / 64.0) AS BIGINT) AS n, CAST(round(target) AS BIGINT) AS take FROM t),
q AS (SELECT *, CASE WHEN s > 0 THEN take // s ELSE 0 END AS full_passes, take - CASE WHEN s > 0 THEN take // s ELSE 0 END * s AS rest FROM p),
r AS (SELECT *, CAST(full_passes * n + ceil(rest / 64.0) AS BIGINT) AS slots FROM q),
z AS (SELECT *, greatest(1, CAST(ceil(sum(slots) OVER () / 4096) AS BIGINT)) AS shards FROM r),
sl AS (SELECT *, unnest(range(slots)) AS i FROM z WHERE slots > 0),
sh AS (SELECT *, """ + drawn("i", "(no * 1009 + 17)", "shards") + """ AS shard FROM sl),
nu AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY shard, i) - 1 AS j FROM sh),
x AS (SELECT *, j // n AS pass, j % n AS step FROM nu),
ks AS (SELECT *, [""" + drawn("r", "(no * 31 + pass + 17)", "n") + """ FOR r IN range(1, 17)] AS keys FROM x),
v AS (SELECT source, shard, list_reduce(list_prepend(step, keys), lambda a, k: CASE WHEN """ + SWAP + " THEN " + MIRROR + """ ELSE a END) AS block,
      CASE WHEN pass = full_passes AND j = slots - 1 THEN rest - step * 64 ELSE 64 END AS most FROM ks),
j AS (SELECT st.doc_id, st.source, st.size, st.h, st.same, greatest(0, least(st.start + st.size, v.block * 64 + v.most) - greatest(st.start, v.block * 64)) AS words, v.shard
      FROM st JOIN v ON v.source IS NOT DISTINCT FROM st.source AND v.block >= st.start // 64 AND v.block <= (st.start + st.size - 1) // 64 WHERE st.size > 0),
g AS (SELECT doc_id, source, size, h, same, sum(words) AS taken, min(shard) FILTER (words > 0) AS first_shard FROM j GROUP BY 1, 2, 3, 4, 5)
SELECT st.doc_id, st.size::BIGINT AS size, t.s AS source_size, t.target, coalesce(g.taken, 0)::BIGINT AS taken, g.first_shard::BIGINT AS first_shard
FROM st JOIN t ON t.source IS NOT DISTINCT FROM st.source LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM st.doc_id AND g.source IS NOT DISTINCT FROM st.source AND g.size = st.size AND g.h = st.h AND g.same = st.same""",
    "op2_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS m FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN m IS NULL OR m IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m IS DISTINCT FROM page_id THEN m END AS refers_to FROM p LEFT JOIN g USING (payload_digest)""",
    "op3_topk": """WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20""",
    "op8_substring": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT k, min(doc_id) AS m FROM win GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN m USING (k) WHERE doc_id > m),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_hard_negatives": """WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding, label) AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.r = p.r WHERE p.place <= 5 AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3""",
    "op13_merkle": """WITH RECURSIVE f AS (SELECT doc_id, source, '' || """ + " || ".join(sized_value(c) for c in ("doc_id", "source", "lang", "n_chars")) + """ AS head, text FROM documents),
l AS (SELECT doc_id, source, sha256(head || """ + sized_value("text") + """) AS leaf, CASE WHEN """ + CRC32 + """ % 2 = 0 THEN sha256(head || """ + sized_value("replace(text, chr(10), '')") + """) END AS cut FROM f),
g AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS groups FROM (SELECT DISTINCT source FROM l)),
a AS MATERIALIZED (SELECT tree, groups, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, doc_id, leaf, cut FROM l JOIN g ON l.source IS NOT DISTINCT FROM g.source),
t AS (SELECT tree, 0 AS level, i, n, leaf AS d FROM a UNION ALL SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, level, i // 3, n),
s AS MATERIALIZED (SELECT x.tree, x.level, x.i, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS lft, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS rgt FROM t x JOIN t y ON y.tree = x.tree AND y.level = x.level AND y.i // 3 = x.i // 3 WHERE x.n > 1 GROUP BY 1, 2, 3),
sub AS (SELECT tree, d AS subroot FROM t WHERE n = 1),
u AS (SELECT 0 AS level, tree AS i, (SELECT any_value(groups) FROM g) AS n, subroot AS d FROM sub UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 3, n),
us AS MATERIALIZED (SELECT x.level, x.i, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS lft, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS rgt FROM u x JOIN u y ON y.level = x.level AND y.i // 3 = x.i // 3 WHERE x.n > 1 GROUP BY 1, 2),
up AS (SELECT tree, i AS leaf_no, 0 AS level, i, coalesce(cut, leaf) AS d, '' AS path FROM a UNION ALL SELECT up.tree, leaf_no, up.level + 1, up.i // 3, sha256(lft || d || rgt), path || lft || rgt FROM up JOIN s ON s.tree = up.tree AND s.level = up.level AND s.i = up.i),
top AS (SELECT tree, leaf_no, arg_max(d, level) AS d, arg_max(path, level) AS path FROM up GROUP BY 1, 2),
over_groups AS (SELECT tree, leaf_no, 0 AS level, tree AS i, d, path FROM top UNION ALL SELECT o.tree, leaf_no, o.level + 1, o.i // 3, sha256(lft || d || rgt), path || lft || rgt FROM over_groups o JOIN us ON us.level = o.level AND us.i = o.i),
fin AS (SELECT tree, leaf_no, arg_max(d, level) AS folded_root, sha256(arg_max(path, level)) AS proof_sha256 FROM over_groups GROUP BY 1, 2)
SELECT a.doc_id, a.leaf, sub.subroot, r.d AS root, fin.proof_sha256, fin.folded_root, fin.folded_root = r.d AS verified
FROM a JOIN sub USING (tree) JOIN fin ON fin.tree = a.tree AND fin.leaf_no = a.i, (SELECT d FROM u WHERE n = 1) r""",
}
