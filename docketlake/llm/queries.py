"""Queries over the driver tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op4_decontamination
from .exact_dedup import SQL_OP1, op1_exact_dedup
from .jaccard_join import op5_jaccard_join
from .lm_scoring import op3_lm_scoring
from .packing import op7_packing
from .prefix_trie import SQL_OP11, op11_prefix_trie
from .quality import op6_quality
from .sharding import op2_sharding
from .substring_dedup import op10_substring_dedup
from .surrogates import op8_surrogates
from .toxicity import op12_toxicity
from .vector_codes import SQL_OP13, op13_vector_codes
from .warc import op9_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_sharding, op3_lm_scoring, op4_decontamination, op5_jaccard_join, op6_quality, op7_packing,
        op8_surrogates, op9_warc, op10_substring_dedup, op11_prefix_trie, op12_toxicity, op13_vector_codes,
    )
}

SQL_OP5 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a
), c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM t LEFT JOIN n USING (doc_id) JOIN c ON c.node = t.doc_id
"""

SQL_OP10 = r"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)
), f AS (SELECT k, min(doc_id) AS owner FROM g GROUP BY k
), d AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (k) WHERE owner < doc_id
), u AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t)
), a AS (
  SELECT u.doc_id, count(*) FILTER (d.p IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY u.p) FILTER (d.p IS NULL), '') AS kept
  FROM u LEFT JOIN d ON d.doc_id = u.doc_id AND d.p = u.p GROUP BY u.doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN a USING (doc_id)
"""

ORACLES = {"op1_exact_dedup": SQL_OP1, "op5_jaccard_join": SQL_OP5, "op10_substring_dedup": SQL_OP10, "op11_prefix_trie": SQL_OP11, "op13_vector_codes": SQL_OP13}
