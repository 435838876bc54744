"""DuckDB SQL for the queries of this package that SQL can express; the others are tested by brute force."""

ORACLES: dict[str, str] = {}

ORACLES["rollup_by_words"] = r"""
SELECT source, lang, 'words-1' AS tokenizer, count(*)::BIGINT AS docs, sum(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')))::BIGINT AS tokens FROM documents
WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL) GROUP BY ALL
"""

ORACLES["op9_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS k FROM s
), u AS (SELECT doc_id, unnest(sh) AS x FROM s
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * m >= 85 * (x.k + y.k - m)
), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.k::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)
"""
