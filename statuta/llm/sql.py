"""Equivalent SQL of the queries that SQL can express, for comparison on small tables."""

_WORDS = r"""regexp_split_to_array(regexp_replace(replace(strip_accents(lower(text)), 'ł', 'l'), '[\p{M}\p{Cf}]+', '', 'g'), '[^\p{L}\p{Nd}]+')"""

_LEAKS = f"""
doc_words AS (SELECT doc_id, list_filter({_WORDS}, lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (SELECT item_id, list_filter({_WORDS}, lambda w: w <> '') AS w FROM eval_items WHERE text IS NOT NULL),
doc_runs AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 10)) AS i FROM doc_words WHERE len(w) >= 12)),
item_runs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 10)) AS i FROM item_words WHERE len(w) >= 12)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (run))"""

_SPANS = """
texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300),
starts AS (
  SELECT doc_id, i, md5(substr(text, i, 300)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, CAST(length(text) AS BIGINT) - 298)) AS i FROM texts)),
common AS (SELECT h FROM starts GROUP BY h HAVING count(DISTINCT doc_id) > 1),
shared AS (SELECT s.* FROM starts s JOIN common USING (h)),
links AS (SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM shared a JOIN shared b ON a.h = b.h AND a.doc_id < b.doc_id)"""

SQL = {
    "p4_exact": """
WITH v AS (
  SELECT DISTINCT coll, point_id, CAST(embedding AS DOUBLE[]) AS e FROM vector_points
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT a.point_id AS p, b.point_id AS q, round(list_cosine_similarity(a.e, b.e), 12) AS s
  FROM v a JOIN v b ON a.coll = b.coll AND a.point_id <> b.point_id),
r AS (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY s DESC, q) AS r FROM s)
SELECT DISTINCT least(p, q) AS point_a, greatest(p, q) AS point_b FROM r WHERE r <= 5""",
    "p6_found": r"""
SELECT DISTINCT act_nro, reconstruct_id FROM vector_acts
WHERE act_nro IS NOT NULL AND reconstruct_id IS NOT NULL AND len(regexp_extract_all(text, '[^ \t\r\n]+')) > 512""",
    "p6_checked": r"""
SELECT act_nro, reconstruct_id, len(regexp_extract_all(text, '[^ \t\r\n]+')) AS n_words, true AS fits, true AS numbered, true AS whole FROM (
SELECT DISTINCT act_nro, reconstruct_id, text FROM vector_acts WHERE act_nro IS NOT NULL AND reconstruct_id IS NOT NULL)
WHERE len(regexp_extract_all(text, '[^ \t\r\n]+')) > 512""",
    "p7_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p7_items": f"""WITH {_LEAKS}
SELECT i.item_id, i.suite, count(DISTINCT l.doc_id) AS n_documents FROM eval_items i LEFT JOIN leaks l USING (item_id) GROUP BY ALL""",
    # Copies are linked to their own representative and to the other text's, and not to each other's copies.
    "p9_found": f"""WITH {_SPANS},
firsts AS (SELECT text, min(doc_id) AS rep FROM documents WHERE text IS NOT NULL GROUP BY text),
member AS (SELECT DISTINCT d.doc_id, f.rep FROM documents d JOIN firsts f USING (text))
SELECT l.doc_a, l.doc_b FROM links l JOIN member a ON a.doc_id = l.doc_a JOIN member b ON b.doc_id = l.doc_b
WHERE CASE WHEN a.rep = b.rep THEN l.doc_a = a.rep ELSE l.doc_a = a.rep OR l.doc_b = b.rep END""",
    "p9_members": """
WITH firsts AS (SELECT text, min(doc_id) AS rep FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT DISTINCT d.doc_id, f.rep, length(d.text) AS n_chars FROM documents d JOIN firsts f USING (text)""",
    "p9_coverage": f"""WITH {_SPANS},
marks AS (
  SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 300) AS before FROM (SELECT DISTINCT doc_id, i FROM shared)),
covered AS (SELECT doc_id, sum(least(300, i - before)) AS n FROM marks GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS rep FROM documents WHERE text IS NOT NULL GROUP BY text),
rep AS (SELECT d.doc_id, f.rep FROM documents d JOIN firsts f USING (text)),
both_ways AS (SELECT doc_a AS x, doc_b AS y FROM links UNION ALL SELECT doc_b, doc_a FROM links),
linked AS (
  SELECT l.x AS doc_id, count(DISTINCT r.rep) AS n FROM both_ways l JOIN rep r ON r.doc_id = l.y JOIN rep o ON o.doc_id = l.x
  WHERE r.rep <> o.rep GROUP BY l.x)
SELECT d.doc_id, max(coalesce(length(d.text), 0)) AS n_chars, CAST(max(coalesce(c.n, 0)) AS BIGINT) AS shared_chars,
       max(coalesce(l.n, 0)) AS n_linked
FROM documents d LEFT JOIN covered c USING (doc_id) LEFT JOIN linked l USING (doc_id) GROUP BY d.doc_id""",
}
