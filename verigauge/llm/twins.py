"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
able AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM v
    UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.vec_id = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

REPEATS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
k AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 33, 1))) AS i, unnest(list_transform(
    range(1, greatest(len(ws) - 33, 1)), lambda i: md5(array_to_string(ws[i:i + 34], ' ')))) AS h FROM d),
again AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM again)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
c AS (SELECT w.doc_id, word, j, coalesce(max(hit.i) OVER (PARTITION BY w.doc_id ORDER BY j) >= j - 34, false) AS gone
    FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id AND hit.i = w.j),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g,
    string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS rest FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(g, 0)::BIGINT AS n_removed,
    sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""

#: Each five hexadecimal digits of a SHA-1 are four characters of base 32.
WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS x FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT
    >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

#: The crc32 of a string in SQL: eight shifts a byte.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y:
    CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT)"""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

#: Levels are lists of nodes; a step of the second recursion hands every leaf up by one level.
MERKLE = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF.format("text")} AS leaf, CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 3 = 0
    THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS forged FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
low AS (SELECT lang, 0 AS level, list(leaf ORDER BY i) AS nodes FROM p GROUP BY lang
    UNION ALL SELECT lang, level + 1, list_transform(range(0, len(nodes), 8), lambda k: sha256(array_to_string(nodes[k + 1:k + 8], '')))
    FROM low WHERE len(nodes) > 1),
sub AS (SELECT lang, level AS h, nodes[1] AS subroot FROM low WHERE len(nodes) = 1),
g AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM sub),
high AS (SELECT 0 AS level, list(subroot ORDER BY r) AS nodes FROM g
    UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 8), lambda k: sha256(array_to_string(nodes[k + 1:k + 8], '')))
    FROM high WHERE len(nodes) > 1),
up AS (SELECT p.doc_id, p.leaf, g.lang, g.h, g.r, g.subroot, 0::BIGINT AS level, p.i, coalesce(p.forged, p.leaf) AS x, '' AS proof
    FROM p JOIN g ON p.lang IS NOT DISTINCT FROM g.lang
    UNION ALL SELECT u.doc_id, u.leaf, u.lang, u.h, u.r, u.subroot, u.level + 1,
        CASE WHEN u.level + 1 = u.h THEN u.r ELSE n.k // 8 END,
        sha256(array_to_string(n.run[:n.k % 8], '') || u.x || array_to_string(n.run[n.k % 8 + 2:], '')),
        u.proof || array_to_string(n.run[:n.k % 8], '') || array_to_string(n.run[n.k % 8 + 2:], '')
    FROM (SELECT up.*, CASE WHEN h = 0 AND level = 0 THEN r ELSE i END AS k0 FROM up) u JOIN (
        SELECT lang, level, FALSE AS top, k, nodes[k // 8 * 8 + 1:k // 8 * 8 + 8] AS run FROM
            (SELECT lang, level, nodes, unnest(range(0, len(nodes))) AS k FROM low WHERE len(nodes) > 1)
        UNION ALL SELECT NULL, level, TRUE, k, nodes[k // 8 * 8 + 1:k // 8 * 8 + 8] FROM
            (SELECT level, nodes, unnest(range(0, len(nodes))) AS k FROM high WHERE len(nodes) > 1)) n
    ON n.top = (u.level >= u.h) AND n.level = u.level - CASE WHEN n.top THEN u.h ELSE 0 END AND n.k = u.k0
        AND (n.top OR n.lang IS NOT DISTINCT FROM u.lang)),
t AS (SELECT max(level) AS th, last(nodes[1] ORDER BY level) AS root FROM high)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified
FROM up, t WHERE up.level = up.h + t.th"""

LINES = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, r, unnest(ls) AS line, unnest(range(len(ls))) AS j FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
s AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM s GROUP BY r, doc_id"""

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Forward: the least (cost, audit) of every state after each turn; j inserts come before a turn.
CONVERSATIONS = f"""WITH RECURSIVE src AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS tag FROM conversations),
hit AS (SELECT *, {_CRC.format("tag")} % 20 AS h FROM src),
bad AS (SELECT id, conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, trim(text, {_BLANK}) AS core,
    left(role, 1) AS c, lag(left(role, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id, copy) AS again
    FROM bad WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), id, copy)),
f AS (SELECT *, CASE WHEN core = '' THEN 1 WHEN again > 1 THEN 2 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM r),
ins AS (SELECT * FROM (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)) t(q, j, s)),
said AS (SELECT *, array_to_string(list_transform(range(j), lambda k: CASE WHEN (k + (q = 2)::INT) % 2 = 0 THEN 'user:' ELSE 'assistant:' END
    || chr(10)), '') AS t FROM ins),
edit AS (SELECT * FROM (VALUES ('D', '', 0, 0), ('D', '', 1, 1), ('D', '', 2, 2), ('D', '', 3, 3), ('K', 's', 0, 1), ('K', 'u', 0, 2), ('K', 'u', 1, 2),
    ('K', 'u', 3, 2), ('K', 'a', 2, 3), ('R', '', 0, 2), ('R', '', 1, 2), ('R', '', 2, 3), ('R', '', 3, 2)) t(e, c, s, q)),
st AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {{'k': 0, 'a': '', 'l': ''}} AS best FROM f
    UNION ALL SELECT conv_id, i, q, min({{'k': k, 'a': a, 'l': l}}) FROM (
        SELECT st.conv_id, f.i, edit.q, st.best.k + 5 * said.j + CASE edit.e WHEN 'D' THEN 2 ELSE (edit.e = 'R')::INT + CASE f.fault WHEN 3 THEN 5 ELSE 0 END END AS k,
            st.best.a || repeat('I', said.j) || edit.e AS a, st.best.l || said.t || CASE edit.e WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10)
            ELSE CASE edit.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text || chr(10) END AS l
        FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1 JOIN said ON said.q = st.q
            JOIN edit ON edit.s = said.s AND (edit.e <> 'K' OR edit.c = f.c) AND (edit.e = 'D' OR f.fault NOT IN (1, 2))) GROUP BY conv_id, i, q),
done AS (SELECT st.conv_id, min({{'k': best.k + 5 * j, 'a': best.a || repeat('I', j), 'l': best.l || t}}) AS b
    FROM st JOIN said ON said.q = st.q AND said.s IN (0, 3) JOIN (SELECT DISTINCT conv_id, n FROM f) m
    ON m.conv_id IS NOT DISTINCT FROM st.conv_id AND m.n = st.i GROUP BY st.conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(b.k, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit,
    sha256(coalesce(left(b.l, length(b.l) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id"""
