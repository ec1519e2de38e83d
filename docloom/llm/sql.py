"""SQL that states the same results over the same tables, for the driver's comparison."""

_PLAIN = r"regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')"

P6_FOUND = rf"""
WITH c AS (SELECT DISTINCT pk, text FROM chunk_record),
parts AS (SELECT pk, unnest(string_split_regex(text, '[\n;|]')) AS part FROM c),
fields AS (
  SELECT pk, string_agg(regexp_replace(lower(part), '[^\p{{L}}\p{{N}}]+', '', 'g'), '|' ORDER BY regexp_replace(lower(part), '[^\p{{L}}\p{{N}}]+', '', 'g')) AS f
  FROM parts WHERE regexp_matches(part, '\S') GROUP BY pk
  HAVING count(*) >= 3 AND bool_and(regexp_matches(part, '^[A-Za-z_ \t]*[A-Za-z_][A-Za-z_ \t]*:(.|\n)*\S'))),
k AS (SELECT c.pk, {_PLAIN} AS p, f FROM c LEFT JOIN fields USING (pk)),
one AS (SELECT pk, p, least(min(pk) OVER (PARTITION BY p), CASE WHEN f IS NULL THEN pk ELSE min(pk) OVER (PARTITION BY f) END) AS a, f FROM k),
two AS (SELECT pk, p, f, least(min(a) OVER (PARTITION BY p), CASE WHEN f IS NULL THEN a ELSE min(a) OVER (PARTITION BY f) END) AS b FROM one),
three AS (SELECT pk, least(min(b) OVER (PARTITION BY p), CASE WHEN f IS NULL THEN b ELSE min(b) OVER (PARTITION BY f) END) AS kept FROM two)
SELECT kept AS kept_pk, pk AS copy_pk FROM three WHERE pk > kept
"""

P1_FOUND = rf"""
WITH recs AS (
  SELECT DISTINCT 'document_record' AS rec_table, pk, text_content AS text FROM document_record
  UNION ALL SELECT DISTINCT 'chunk_record', pk, text FROM chunk_record),
w AS (SELECT rec_table, pk, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM recs),
sh AS (
  SELECT DISTINCT rec_table, pk, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
  FROM (SELECT rec_table, pk, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
n AS (SELECT rec_table, pk, count(*) AS n FROM sh GROUP BY ALL),
pairs AS (
  SELECT a.rec_table, a.pk AS pk_a, b.pk AS pk_b, count(*) AS c
  FROM sh a JOIN sh b ON a.rec_table = b.rec_table AND a.s = b.s AND a.pk < b.pk GROUP BY ALL),
hit AS (
  SELECT p.rec_table, pk_a, pk_b FROM pairs p JOIN n x ON x.rec_table = p.rec_table AND x.pk = pk_a
  JOIN n y ON y.rec_table = p.rec_table AND y.pk = pk_b WHERE c * 10 >= 7 * (x.n + y.n - c)),
copies AS ({P6_FOUND}),
class AS (SELECT copy_pk AS pk, kept_pk AS k FROM copies UNION SELECT kept_pk, kept_pk FROM copies)
SELECT rec_table, pk_a, pk_b FROM hit LEFT JOIN class u ON u.pk = pk_a LEFT JOIN class v ON v.pk = pk_b
WHERE rec_table = 'document_record' OR u.k IS NULL OR v.k IS NULL OR u.k <> v.k
"""

P1_GROUPS = r"""
WITH RECURSIVE recs AS (
  SELECT DISTINCT 'document_record' AS rec_table, pk, text_content AS text FROM document_record
  UNION ALL SELECT DISTINCT 'chunk_record', pk, text FROM chunk_record),
w AS (SELECT rec_table, pk, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM recs),
sh AS (SELECT DISTINCT rec_table, pk, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT rec_table, pk, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
sets AS (SELECT rec_table, pk, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS m FROM sh GROUP BY ALL),
cls AS (SELECT rec_table, pk, n, min(pk) OVER (PARTITION BY rec_table, m) AS class_pk, count(*) OVER (PARTITION BY rec_table, m) AS copies FROM sets),
reps AS (SELECT rec_table, pk, n FROM cls WHERE pk = class_pk),
rs AS (SELECT sh.* FROM sh JOIN reps USING (rec_table, pk)),
pairs AS (SELECT a.rec_table, a.pk AS a, b.pk AS b, count(*) AS c FROM rs a JOIN rs b ON a.rec_table = b.rec_table AND a.s = b.s AND a.pk < b.pk GROUP BY ALL),
hit AS (SELECT p.rec_table, a, b FROM pairs p JOIN reps x ON x.rec_table = p.rec_table AND x.pk = a JOIN reps y ON y.rec_table = p.rec_table AND y.pk = b WHERE c * 10 >= 7 * (x.n + y.n - c)),
ends AS (SELECT rec_table, a, b FROM hit UNION ALL SELECT rec_table, b, a FROM hit),
reach AS (SELECT rec_table, pk AS a, pk AS b FROM reps UNION SELECT r.rec_table, r.a, e.b FROM reach r JOIN ends e ON e.rec_table = r.rec_table AND e.a = r.b),
grp AS (SELECT rec_table, a, min(b) AS group_pk FROM reach GROUP BY ALL)
SELECT cls.rec_table, cls.pk, class_pk, group_pk, copies FROM cls JOIN grp ON grp.rec_table = cls.rec_table AND grp.a = class_pk
"""

P2_FOUND = """
WITH v AS (
  SELECT DISTINCT chunk_id, vector::DOUBLE[] AS x FROM vector_point
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda e: isnan(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0),
s AS (
  SELECT q.chunk_id, v.chunk_id AS neighbour_id, list_cosine_similarity(q.x, v.x) AS c
  FROM (SELECT DISTINCT chunk_id FROM probe_point) JOIN v q USING (chunk_id) JOIN v ON v.chunk_id <> q.chunk_id)
SELECT chunk_id, neighbour_id FROM s QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY c DESC, neighbour_id) <= 10
"""

P2_NEIGHBOURS = """
WITH v AS (
  SELECT DISTINCT chunk_id, vector::DOUBLE[] AS x FROM vector_point
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda e: isnan(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0),
s AS (
  SELECT q.chunk_id, v.chunk_id AS neighbour_id, list_cosine_similarity(q.x, v.x) AS c
  FROM (SELECT DISTINCT id AS chunk_id FROM chunk_record WHERE pk % 100 = 0) JOIN v q USING (chunk_id) JOIN v ON v.chunk_id <> q.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY c DESC, neighbour_id) AS rank FROM s)
SELECT chunk_id, neighbour_id, round(c, 5) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10
"""

_P3 = r"""
WITH d AS (SELECT DISTINCT pk, crate, text_content AS text FROM document_record),
l AS (SELECT pk, crate, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM d),
n AS (SELECT pk, crate, line_no, raw, lower(trim(regexp_replace(raw, '[ \t]+', ' ', 'g'))) AS line FROM l),
p AS (SELECT crate, count(DISTINCT pk) AS pages FROM d GROUP BY crate),
k AS (SELECT crate, line FROM n JOIN p USING (crate) WHERE length(line) >= 15 GROUP BY crate, line, pages HAVING count(DISTINCT pk) >= 8 AND count(DISTINCT pk) >= 0.05 * pages)
"""
P3_FOUND = _P3 + "SELECT pk, line_no FROM n JOIN k USING (crate, line)"
P3_CLEANED = _P3 + """
SELECT pk, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE k.line IS NULL), '') AS text, count(k.line) AS removed
FROM n LEFT JOIN k USING (crate, line) GROUP BY pk"""

P3_BLOCKS = "WITH RECURSIVE " + _P3.strip().removeprefix("WITH ") + """,
f AS (SELECT DISTINCT pk, crate, line_no, line FROM n JOIN k USING (crate, line)),
e AS (
  SELECT crate, least(a.line, b.line) AS a, greatest(a.line, b.line) AS b FROM f a JOIN f b USING (pk, crate) JOIN p USING (crate)
  WHERE b.line_no - a.line_no IN (1, 2) AND a.line <> b.line
  GROUP BY crate, least(a.line, b.line), greatest(a.line, b.line), pages HAVING count(DISTINCT pk) >= 8 AND count(DISTINCT pk) >= 0.05 * pages),
ends AS (SELECT crate, a, b FROM e UNION ALL SELECT crate, b, a FROM e),
reach AS (SELECT crate, line AS a, line AS b FROM k UNION SELECT r.crate, r.a, x.b FROM reach r JOIN ends x ON x.crate = r.crate AND x.a = r.b),
block AS (SELECT crate, a AS line, min(b) AS block_line FROM reach GROUP BY ALL),
support AS (SELECT crate, line, count(DISTINCT pk) AS s FROM f GROUP BY ALL)
SELECT crate, block_line, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY line)) AS members, max(s) AS strongest
FROM block JOIN support USING (crate, line) GROUP BY crate, block_line HAVING count(*) > 1
"""

P4_FOUND = """
SELECT DISTINCT 'document_record' AS rec_table, pk FROM document_record WHERE length(text_content) > 1400
UNION ALL SELECT DISTINCT 'chunk_record', pk FROM chunk_record WHERE length(text) > 1400
"""

P8_FOUND = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(passage), '[a-z0-9]+') AS w FROM eval_passage),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
es AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM ds JOIN es USING (s)
"""

ORACLE: dict[str, str] = {
    "p1_found": P1_FOUND,
    "p1_groups": P1_GROUPS,
    "p2_found": P2_FOUND,
    "p2_neighbours": P2_NEIGHBOURS,
    "p3_found": P3_FOUND,
    "p3_cleaned": P3_CLEANED,
    "p3_blocks": P3_BLOCKS,
    "p4_found": P4_FOUND,
    "p4_coverage": "SELECT rec_table, pk, max(n) AS chars, true AS whole FROM (SELECT 'document_record' AS rec_table, pk, length(text_content) AS n FROM document_record UNION ALL SELECT 'chunk_record', pk, length(text) FROM chunk_record) WHERE n > 1400 GROUP BY ALL",
    "p6_found": P6_FOUND,
    "p7_whole": "SELECT doc_id, coalesce(text, '') <> '' AS placed, true AS whole FROM documents",
    "p8_found": P8_FOUND,
}
