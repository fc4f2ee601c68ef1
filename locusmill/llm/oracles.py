"""DuckDB SQL of the text operators that SQL can express."""

WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e FROM embeddings),
links AS (SELECT a.vec_id x, b.vec_id y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id x, vec_id y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x, MIN(y) component_id FROM reach GROUP BY x)
SELECT vec_id, (SELECT COUNT(*) FROM links WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON x = vec_id"""

MIXING = f"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) size, md5(COALESCE(CAST(doc_id AS VARCHAR), '')) turn FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) source_size, CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END weight FROM d GROUP BY source),
l AS (SELECT *, source_size * 3 most, SUM(source_size) OVER () - COALESCE(SUM(source_size * 3) OVER (ORDER BY source_size * 3 / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) rest,
  SUM(weight) OVER (ORDER BY source_size * 3 / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) heavy FROM s),
f AS (SELECT *, most * heavy < rest * weight stopped FROM l),
t AS (SELECT source, source_size, CASE WHEN stopped THEN CAST(most AS DOUBLE) ELSE CAST((SUM(source_size) OVER () - SUM(CASE WHEN stopped THEN most ELSE 0 END) OVER ()) * weight AS DOUBLE) / CAST(SUM(CASE WHEN stopped THEN 0 ELSE weight END) OVER () AS DOUBLE) END target FROM f),
q AS (SELECT d.*, t.source_size, t.target, CAST(SUM(size) OVER (PARTITION BY d.source ORDER BY turn, size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT q.*, p FROM q, (SELECT UNNEST([0, 1, 2]) p) WHERE size > 0 AND p * source_size + cum - size < target),
m AS (SELECT *, SUM(size) OVER (ORDER BY CAST(p * source_size + cum AS DOUBLE) / target, source NULLS LAST, cum, p ROWS UNBOUNDED PRECEDING) sent FROM e),
k AS (SELECT source, cum, CAST(SUM(size) AS BIGINT) taken FROM m WHERE sent <= (SELECT SUM(source_size) FROM t) GROUP BY source, cum)
SELECT q.doc_id, q.size, q.source_size, q.target, COALESCE(k.taken, 0) AS taken FROM q LEFT JOIN k ON q.source IS NOT DISTINCT FROM k.source AND q.cum = k.cum AND q.size > 0"""

REPEATS = f"""WITH w AS (SELECT doc_id, {WORDS} ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') k FROM (SELECT doc_id, ws, UNNEST(RANGE(1, len(ws) - 33)) i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY k) c FROM win) WHERE c > 1),
one AS (SELECT doc_id, UNNEST(ws) word, UNNEST(RANGE(1, len(ws) + 1)) j FROM w),
gone AS (SELECT o.doc_id, o.word, o.j, COALESCE(MAX(a.i) OVER (PARTITION BY o.doc_id ORDER BY o.j ROWS UNBOUNDED PRECEDING) >= o.j - 34, false) g FROM one o LEFT JOIN again a ON a.doc_id = o.doc_id AND a.i = o.j),
per AS (SELECT doc_id, COUNT(*) FILTER (g) n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT g) kept FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM w LEFT JOIN per ON per.doc_id = w.doc_id"""
