"""SQL that gives the same rows as a query of ``queries``, where SQL can express it on whole tables."""

W = "[ \\t\\r\\n]"

SQL = {
    # Usable vectors; the ten most similar of each by cosine, then the pairs of 0.85 and more.
    "p4_found": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM chunk_vectors WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, list_transform(e, lambda x: (x / sqrt(list_dot_product(e, e)))) AS e FROM v WHERE list_dot_product(e, e) > 0),
s AS (SELECT a.vec_id AS id, b.vec_id AS other, list_dot_product(a.e, b.e) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 5) DESC, other) AS k FROM s)
SELECT DISTINCT least(id, other) AS vec_id_a, greatest(id, other) AS vec_id_b FROM r WHERE k <= 10 AND s >= 0.85""",
    "p5_found": f"""
WITH t AS (SELECT DISTINCT 'page' AS rec, page_id::VARCHAR AS rec_key, text AS t FROM pages WHERE length(text) > 1400 UNION SELECT DISTINCT 'chunk', id, body FROM chunks WHERE length(body) > 1400),
m AS (SELECT rec, rec_key,
  list_max(list_transform(regexp_split_to_array(t, '[ \\t\\r]*\\n[ \\t\\r]*\\n{W}*'), lambda p: length(regexp_replace(p, '^{W}+|{W}+$', '', 'g')))) AS paragraph,
  list_max(list_transform(string_split(regexp_replace(regexp_replace(t, '[ \\t\\r]*\\n[ \\t\\r]*\\n{W}*', chr(1), 'g'), '([.!?]){W}+', '\\1' || chr(1), 'g'), chr(1)), lambda p: length(regexp_replace(p, '^{W}+|{W}+$', '', 'g')))) AS sentence,
  list_max(list_transform(regexp_split_to_array(t, '{W}+'), lambda p: length(p))) AS word FROM t)
SELECT rec, rec_key, CASE WHEN paragraph <= 1400 THEN 'paragraph' WHEN sentence <= 1400 THEN 'sentence' WHEN word <= 1400 THEN 'word' ELSE 'hard' END AS boundary FROM m""",
    # What the pieces of a text hold beside overlaps and white space is the text without its white space.
    "p5_covered": f"""
WITH t AS (SELECT DISTINCT 'page' AS rec, page_id::VARCHAR AS rec_key, text AS t FROM pages WHERE length(text) > 1400 UNION SELECT DISTINCT 'chunk', id, body FROM chunks WHERE length(body) > 1400)
SELECT rec, rec_key, sha1(regexp_replace(t, '{W}+', '', 'g')) AS digest, true AS within, true AS overlaps FROM t""",
    # Encoding and decoding give the text again; nothing of a null one.
    "p8_decoded": "SELECT doc_id, sha1(coalesce(text, '')) AS digest FROM documents",
    "p9_kept": "SELECT DISTINCT mix, source, true AS within, 0 AS twice FROM mix_targets",
    # Sets of three successive words; pairs that share half of their union.
    "p7_found": """
WITH w AS (SELECT page_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM (SELECT DISTINCT page_id, text FROM pages)),
g AS (SELECT page_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w),
n AS (SELECT page_id, count(*) AS n FROM g GROUP BY page_id),
c AS (SELECT a.page_id AS page_id_a, b.page_id AS page_id_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.page_id < b.page_id GROUP BY ALL)
SELECT page_id_a, page_id_b FROM c JOIN n x ON x.page_id = page_id_a JOIN n y ON y.page_id = page_id_b WHERE c * 2 >= x.n + y.n - c""",
}
