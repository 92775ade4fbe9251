"""DuckDB forms of the operators that SQL can express on whole tables, by plain exact means."""

from __future__ import annotations

from .decontaminate import CONTAINMENT
from .ngram_join import NGRAM, THRESHOLD
from .suffix_dedup import LENGTH

#: The words of ``blocks``: ASCII letters and digits and characters beyond ASCII without some punctuation blocks.
_WORD = r"[0-9A-Za-z\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3004}-\x{10FFFF}]+"


def _words(table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM {table} WHERE {key} IS NOT NULL"


_GRAMS = f"CASE WHEN len(w) >= {NGRAM} THEN list_distinct(list_transform(range(1, len(w) - {NGRAM - 2}), lambda i: array_to_string(w[i:i + {NGRAM - 1}], ' '))) ELSE [array_to_string(w, ' ')] END"

NGRAM_JOIN = f"""WITH RECURSIVE listed AS ({_words('documents', 'doc_id')}),
nodes AS (SELECT array_to_string(w, ' ') AS k, min(doc_id) AS node, count(*) AS n_copies, first(w) AS w FROM listed WHERE len(w) > 0 GROUP BY 1),
grams AS (SELECT node, unnest({_GRAMS}) AS g FROM nodes),
sizes AS (SELECT node, count(*) AS n FROM grams GROUP BY node),
shared AS (SELECT a.node AS a, b.node AS b, count(*) AS n FROM grams a JOIN grams b USING (g) WHERE a.node < b.node GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE s.n >= {THRESHOLD} * (x.n + y.n - s.n) - 1e-9),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node, node AS other FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN both_ e ON r.other = e.a),
classes AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
degrees AS (SELECT a AS node, count(*) AS n FROM both_ GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(d.n, 0) AS n_links, coalesce(n_copies, 1) AS n_copies, CAST(len(listed.w) AS BIGINT) AS n_words
FROM listed LEFT JOIN nodes ON len(listed.w) > 0 AND k = array_to_string(listed.w, ' ') LEFT JOIN classes USING (node) LEFT JOIN degrees d USING (node)"""

DECONTAMINATION = f"""WITH docs AS ({_words('documents', 'doc_id')}), items AS ({_words('benchmark', 'item_id')}),
doc_grams AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM docs WHERE len(w) > 0),
item_grams AS (SELECT item_id, unnest({_GRAMS}) AS g FROM items WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_grams GROUP BY 1),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc_grams JOIN item_grams USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item FROM shared JOIN sizes USING (item_id) WHERE n_shared >= {CONTAINMENT} * n_item - 1e-9"""

SUFFIX_DEDUP = f"""WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, s, substr(h, 2 * s + 1, {2 * LENGTH}) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS s FROM docs WHERE length(h) >= {2 * LENGTH})),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM strings) WHERE k > 1),
marked AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {LENGTH} THEN 1 ELSE 0 END AS new FROM later),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marked),
runs AS (SELECT doc_id, min(s) AS a, max(s) + {LENGTH} AS b FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS stop, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)"""

_FIVE = "CAST('0x' || substr(d, 5 * g + 1, 5) AS BIGINT)"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({v} >> {shift}) & 31) + 1 AS BIGINT), 1)"
_BASE32 = "array_to_string(list_transform(range(0, 8), lambda g: " + " || ".join(_LETTER.format(v=_FIVE, shift=s) for s in (15, 10, 5, 0)) + "), '')"
WARC = f"""WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages WHERE page_id IS NOT NULL),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM hashed)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM firsts"""
