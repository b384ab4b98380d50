"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(c: str) -> str:
    return f"translate({c}, '{_UPPER}', '{_LOWER}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _place(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_HOST = r"^[a-z0-9+.-]*://([^/?#]*\.)?"
_END = r"([^a-z0-9_.%-]|$)"
_BLOCK = [_HOST + r"spam-farm\.", r"^[a-z0-9+.-]*://(?s:.*)-farm\.example\.", _HOST + r"cheap-pills\.", r"^[a-z0-9+.-]*://(?s:.*)pills\.(?s:.*)/buy" + _END,
          _HOST + r"ads-track\.", _HOST + r"ads\.", _HOST + r"adserver\.", _HOST + "casino" + _END, r"-casino\.", r"\.casino\.", "/ads/banner" + _END,
          "/adclick" + _END, "/doubleclick" + _END, r"/popunder\.", r"\?affiliate=", "&affiliate=", "/viagra" + _END, "/porn" + _END, r"\.xxx" + _END,
          _HOST + r"free-money\."]
_ALLOW = ["/en/1/", _HOST + r"ads-track\.(?s:.*)/privacy" + _END]


def _any(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(low, {_quoted(p)})" for p in patterns) + ")"


URL_RULES = f"""WITH a AS (SELECT page_id, {_ascii_lower('url')} AS low,
 CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS main FROM pages),
b AS (SELECT page_id, coalesce(low, '') AS low, low IS NULL AS missing, coalesce(regexp_extract(main, '^[^/]*'), '') AS raw, coalesce(main, '') AS main FROM a),
c AS (SELECT page_id, low, missing, {_ascii_lower('raw')} AS host, substr(main, length(raw) + 1) AS path FROM b),
d AS (SELECT *, CASE WHEN {_place('example.org', '/en/1')} THEN 'example.org/en/1' WHEN {_place('example.org', '/es/')} THEN 'example.org/es/'
 WHEN {_place('com', '/fr/')} THEN 'com/fr/' WHEN {_place('com', '/de/')} THEN 'com/de/' WHEN {_place('org', '/')} THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
 WHEN NOT missing AND {_any(_BLOCK)} AND NOT {_any(_ALLOW)} THEN 'block' ELSE 'allow' END AS verdict FROM d"""

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_ascii_lower("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
 ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS gram FROM w),
n AS (SELECT d.doc_id, count(s.gram) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL"""

_KINDS = [
    ("assign", "secret", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", "identifier", r"(AKIA[A-Z0-9]+)", 18),
    ("hex", "secret", r"([0-9a-f]+)", 16),
    ("weak_id", "identifier", r"""\b(?i:user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)""", 3),
    ("weak_secret", "secret", r"""\b(?i:pass|pwd|pw|auth|credential|private_?key)["']?\x20*[:=]\x20*["']?([^\x20\x09-\x0D"',;]+)""", 6),
    ("endpoint", "endpoint", r"""((?:https?|ftp|jdbc|postgres|mysql|redis|amqp|mongodb)://[^\x20\x09-\x0D"'<>]+)""", 10),
]


def _kind(i: int, name: str, role: str, pattern: str, least: int) -> str:
    p = _quoted(pattern)
    return f"""k{i} AS (SELECT doc_id, unnest(regexp_extract_all(t, {p})) AS m, unnest(regexp_extract_all(t, {p}, 1)) AS part,
 unnest(list_slice(string_split_regex(t, {p}), 1, len(regexp_extract_all(t, {p})))) AS gap, unnest(range(1, len(regexp_extract_all(t, {p})) + 1)) AS i FROM d),
p{i} AS (SELECT doc_id, {i} AS rank, '{name}' AS kind, '{role}' AS role, sum(length(gap) + length(m)) OVER w - length(m) AS s, sum(length(gap) + length(m)) OVER w AS e,
 length(part) >= {least} AS good FROM k{i} WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


SECRETS = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), " + ",\n".join(_kind(i, *k) for i, k in enumerate(_KINDS)) + """,
q AS (""" + " UNION ALL ".join(f"SELECT * FROM p{i} WHERE good" for i in range(len(_KINDS))) + """),
near AS (SELECT a.doc_id, a.rank, a.s, a.e, bool_or(b.rank < 3 AND b.s < a.e AND a.s < b.e) AS covered, bool_or(b.role = 'identifier') AS ids,
 bool_or(b.role = 'secret') AS secrets FROM q a JOIN q b ON a.doc_id = b.doc_id AND (a.rank, a.s) <> (b.rank, b.s) AND b.s - a.e <= 300 AND a.s - b.e <= 300
 WHERE a.rank >= 3 GROUP BY ALL),
kept AS (SELECT doc_id, rank, s, e FROM q WHERE rank < 3 UNION ALL SELECT doc_id, rank, s, e FROM near WHERE NOT covered
 AND CASE rank WHEN 3 THEN secrets WHEN 4 THEN ids ELSE ids AND secrets END),
named AS (SELECT *, ['assign', 'access', 'hex', 'weak_id', 'weak_secret', 'endpoint'][rank + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS span FROM kept),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS h,
 coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
 coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)"""

_ESCAPED = r"""regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>|<NAME>>)', '\1\\\2\3', 'g')"""

CHATS = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
o AS (SELECT *, CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 25 + length(role) END + length({_ESCAPED}) AS size FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text)) AS said,
 coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (role = 'assistant'), '') AS loss, sum(size)::BIGINT AS formatted_chars FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM v
 WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
 WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""



def _crc(number: str) -> str:
    """The unsigned CRC-32 of a number's decimal digits, bit by bit."""
    digits = f"list_transform(string_split(({number})::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)"
    byte = "list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {digits}), lambda c, b: {byte}), 4294967295::UBIGINT)"


TRIE = f"""WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
 FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT DISTINCT c, c - c % {100} AS b, {_crc('c')} % 6 AS h FROM o),
t AS (SELECT h.c, o.i AS k, role, text FROM h JOIN o ON o.c = h.b AND o.i <= h.h UNION ALL SELECT h.c, 10 + o.i, role, text FROM h JOIN o ON o.c = h.c AND o.i > h.h),
r AS (SELECT c, row_number() OVER w AS d, length(text) AS size, string_agg(sha256(strlen(role)::VARCHAR || ':' || role || text), '' ORDER BY k) OVER w AS path
 FROM t WINDOW w AS (PARTITION BY c ORDER BY k)),
m AS (SELECT c, 0 AS d, 0 AS size, '' AS node FROM h UNION ALL SELECT c, d, size, sha256(path) FROM r),
p AS (SELECT m.*, u.node AS parent, m.d = max(m.d) OVER (PARTITION BY m.c) AS ends FROM m LEFT JOIN m u ON u.c = m.c AND u.d = m.d - 1),
n AS (SELECT d, node, any_value(parent) AS parent, min(c) AS c, count(*) AS n, any_value(size) AS size,
 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, node),
k AS (SELECT d - 1 AS d, parent AS node, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (d, node)),
s AS (SELECT a.d, a.node, count(*) FILTER (f.kids = 0) AS n_leaves, sum((f.n - 1) * f.size)::BIGINT AS saved FROM f JOIN m a ON a.c = f.c AND a.d <= f.d GROUP BY ALL)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, q.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, n_leaves, saved AS saved_tokens, f.ends_sha256
 FROM f JOIN s ON s.d = f.d AND s.node = f.node LEFT JOIN f q ON q.d = f.d - 1 AND q.node = f.parent"""


def _leaf(text: str) -> str:
    said = lambda v: f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    return "sha256(" + " || ".join(map(said, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_RUN = "PARTITION BY tree, level, place // 3 ORDER BY place ROWS BETWEEN"
_SIDES = f"""SELECT *, count(*) OVER (PARTITION BY tree, level) AS n, coalesce(string_agg(digest, '' ORDER BY place) OVER ({_RUN} 2 PRECEDING AND 1 PRECEDING), '') AS l,
 coalesce(string_agg(digest, '' ORDER BY place) OVER ({_RUN} 1 FOLLOWING AND 2 FOLLOWING), '') AS r"""


def _up(nodes: str) -> str:
    return f"""SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM
 (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}) x WHERE n > 1 GROUP BY tree, level, place // 3"""


MERKLE = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {_leaf('text')} AS leaf,
 {_leaf("CASE WHEN " + _crc("coalesce(doc_id, 0)") + " % 2 = 0 AND doc_id IS NOT NULL THEN replace(text, chr(10), '') ELSE text END")} AS copy FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth FROM d),
a AS (SELECT tree, 0 AS level, nth AS place, leaf AS digest FROM q UNION ALL {_up('a')}),
sides AS MATERIALIZED ({_SIDES} FROM a),
tops AS (SELECT tree AS source, '' AS tree, 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS place, digest FROM sides WHERE n = 1),
b AS (SELECT tree, level, place, digest FROM tops UNION ALL {_up('b')}),
over AS MATERIALIZED ({_SIDES} FROM b),
w AS (SELECT doc_id, leaf, tree, 0 AS level, nth AS place, copy AS acc, '' AS proof FROM q UNION ALL
 SELECT doc_id, leaf, w.tree, w.level + 1, w.place // 3, sha256(l || acc || r), proof || l || r FROM w JOIN sides s ON s.tree = w.tree AND s.level = w.level AND s.place = w.place WHERE n > 1),
x AS (SELECT doc_id, leaf, s.digest AS subroot, t.level, t.place, acc, proof FROM w JOIN sides s ON s.tree = w.tree AND s.level = w.level AND n = 1 JOIN tops t ON t.source = w.tree),
y AS (SELECT * FROM x UNION ALL SELECT doc_id, leaf, subroot, y.level + 1, y.place // 3, sha256(l || acc || r), proof || l || r
 FROM y JOIN over o ON o.level = y.level AND o.place = y.place WHERE n > 1)
SELECT doc_id, leaf, subroot, o.digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = o.digest AS verified FROM y JOIN over o ON o.level = y.level AND n = 1"""

REPEATS = """WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM g JOIN m USING (k) WHERE least < doc_id),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w),
r AS (SELECT u.doc_id, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY u.j) FILTER (c.j IS NULL) AS kept FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.j = u.j GROUP BY u.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id"""

ORACLE = {"op1_url_rules": URL_RULES, "op5_ngram_join": NGRAM_JOIN, "op6_secret_scan": SECRETS, "op7_chat_format": CHATS, "op10_embedding_dedup": EMBEDDINGS,
          "op11_prefix_trie": TRIE, "op12_merkle_manifest": MERKLE, "op13_substring_dedup": REPEATS}
