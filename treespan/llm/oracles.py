"""SQL of the corpus queries that SQL can say, over whole tables."""

from __future__ import annotations

#: Words under a window that starts in a document of smaller id, by the windows' words themselves.
SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM d, UNNEST(range(1, len(w) - 11)) t(i) WHERE len(w) >= 13),
m AS (SELECT s, MIN(doc_id) AS least FROM win GROUP BY s),
cut AS (SELECT DISTINCT win.doc_id, i + k AS at FROM win JOIN m ON m.s = win.s, (SELECT UNNEST(range(0, 13)) AS k) WHERE win.doc_id > m.least),
said AS (SELECT doc_id, UNNEST(w) AS word, UNNEST(range(1, len(w) + 1)) AS at FROM d),
kept AS (SELECT said.doc_id, string_agg(word, ' ' ORDER BY said.at) AS text, COUNT(*) AS n FROM said LEFT JOIN cut ON cut.doc_id = said.doc_id AND cut.at = said.at WHERE cut.at IS NULL GROUP BY said.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

#: Bytes under a string of 200 bytes that starts elsewhere, too, by the strings in hexadecimal.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS x, octet_length(encode(COALESCE(text, ''))) AS n FROM documents),
pieces AS (SELECT doc_id, p, substr(x, 400 * p + 1, 800) AS y FROM d, UNNEST(range(0, n // 200 + 1)) t(p) WHERE n >= 200),
win AS (SELECT doc_id, 200 * p + o AS i, md5_number(substr(y, 2 * o + 1, 400)) AS s FROM pieces, (SELECT UNNEST(range(0, 200)) AS o) WHERE length(y) >= 2 * o + 400),
again AS (SELECT s FROM win GROUP BY s HAVING COUNT(*) > 1),
starts AS (SELECT win.doc_id, i, i - COALESCE(LAG(i) OVER (PARTITION BY win.doc_id ORDER BY i), -1000000) AS gap FROM win JOIN again ON again.s = win.s),
numbered AS (SELECT doc_id, i, SUM(CASE WHEN gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts),
runs AS (SELECT doc_id, run, MIN(i) AS a, MAX(i) + 200 AS b FROM numbered GROUP BY doc_id, run),
parts AS (SELECT doc_id, a, b, LAG(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
cut AS (SELECT parts.doc_id, CAST(SUM(b - a) AS BIGINT) AS n_removed, COUNT(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(ANY_VALUE(x), 2 * MAX(b) + 1) AS kept
 FROM parts JOIN d ON d.doc_id = parts.doc_id GROUP BY parts.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(COALESCE(kept, x))) AS kept_sha256 FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""

SQL = {"op5_suffix_array_dedup": SUFFIX_DEDUP, "op9_substring_dedup": SUBSTRING_DEDUP}
