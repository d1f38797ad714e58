"""DuckDB SQL for those queries of this subpackage that SQL can express."""

OP3 = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP5 = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages),
groups AS (
  SELECT page_id, i, ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT AS v
  FROM hashed, range(8) r(i)),
digits AS (
  SELECT page_id, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31)::INT + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31)::INT + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31)::INT + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31)::INT + 1, 1), '' ORDER BY i) AS payload_digest
  FROM groups GROUP BY page_id)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM hashed JOIN digits USING (page_id)
"""

#: Windows of 20 words; the earliest of equal ones stays, words under any other go.
OP10 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS win
  FROM words, range(1, greatest(len(w) - 18, 1)) r(s)),
firsts AS (SELECT win, min((doc_id, s)) AS first FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, s + o AS p
  FROM windows JOIN firsts USING (win), range(20) q(o)
  WHERE (doc_id, s) <> first),
kept AS (
  SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT doc_id, w, p FROM words, range(1, len(w) + 1) r(p)) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.p = x.p)
  GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

#: Shingle sets, pairs of sets that share one, exact counts, components by walking the links.
OP8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g
  FROM words, range(1, greatest(len(w) - 3, 2)) r(s) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n
  HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach r ON r.doc_id = d.doc_id
GROUP BY d.doc_id, n
"""

ORACLES = {"op3_exact_dedup": OP3, "op5_warc": OP5, "op8_jaccard_join": OP8, "op10_substring_dedup": OP10}


def lloyd(k: int, rounds: int, seed: int, dims: int, scale: float) -> str:
    """Rounds of assignment and replacement, one common table expression each."""
    steps = [
        f"""good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM good WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}) x)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
  SELECT g.vec_id, g.v, arg_min(c.c, (d, c.c)) AS c, min(d) AS d
  FROM (SELECT *, row_number() OVER () AS r FROM good) g, c{i} c,
       LATERAL (SELECT list_sum(list_transform(range(1, {dims + 1}), lambda j: (g.v[j] - c.v[j]) * (g.v[j] - c.v[j])))::BIGINT AS d) x
  GROUP BY g.r, g.vec_id, g.v)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT c, list(s ORDER BY j) AS v
  FROM (SELECT c, j, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS s
        FROM (SELECT c, unnest(v) AS x, unnest(range({dims})) AS j FROM a{i}) y GROUP BY c, j) z GROUP BY c),
c{i + 1} AS (SELECT p.c, coalesce(m.v, p.v) AS v FROM c{i} p LEFT JOIN m{i} m USING (c))""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.c::INT AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(p.v, ',')) AS centroid_sha256
FROM {last} a JOIN c{rounds} p ON p.c = a.c"""


ORACLES["op13_centroids"] = lloyd(16, 3, 1, 64, 64.0)
