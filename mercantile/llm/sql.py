"""SQL for DuckDB that gives the rows of those queries that SQL can express, from definitions only:
windows and shingles are compared as strings, vectors all with all, substrings one by one."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the column ``text``.
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Components of the table ``links (a, b)``, both ways: the least id that each reaches.
REACHED = """
reached AS (
    SELECT a, b FROM links
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
),
least_id AS (SELECT a, least(a, min(b)) AS component FROM reached GROUP BY a)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
x AS (
    SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM p) WHERE len(w) >= k)
),
h AS (SELECT DISTINCT x.doc_id, x.i, x.k, p.item_id FROM x JOIN p ON x.s = p.s AND x.k = p.k),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
m AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
        AND len(list_filter(embedding, lambda e: e <> 0)) > 0
),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
{REACHED}
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component, e.vec_id) AS component_id, coalesce(component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON e.vec_id = c.a LEFT JOIN least_id ON e.vec_id = least_id.a
"""


def _escaped(column: str) -> str:
    return rf"replace(replace(replace({column}, '\', '\\'), '###', '\h'), '</turn>', '\e')"


CHAT = rf"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS odd (k, r)
),
g AS (
    SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length('### : </turn>') + 1 + length(replace({_escaped("role")}, ':', '\c')) + length({_escaped("text")})) AS chars
    FROM t GROUP BY conv_id
)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""

#: A shingle that a document holds c times is so many cells as c has binary digits.
NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, w, least(5, len(w)) AS k FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0),
s AS (SELECT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d)),
c AS (SELECT doc_id, hash(k, s) AS s, unnest(range(0, CAST(floor(log2(count(*))) AS BIGINT) + 1)) AS digit FROM s GROUP BY doc_id, k, s),
z AS (SELECT doc_id, s, digit, count(*) OVER (PARTITION BY doc_id) AS n FROM c),
links AS (
    SELECT p.doc_id AS a, q.doc_id AS b FROM z p JOIN z q ON p.s = q.s AND p.digit = q.digit AND p.doc_id <> q.doc_id AND least(p.n, q.n) >= 0.8 * greatest(p.n, q.n)
    GROUP BY p.doc_id, q.doc_id HAVING count(*) >= 0.8 * (any_value(p.n) + any_value(q.n) - count(*)) - 1e-9
),
{REACHED}
SELECT doc_id, coalesce(component, doc_id) AS class_id, coalesce(component, doc_id) = doc_id AS kept FROM documents LEFT JOIN least_id ON doc_id = a
"""

#: Bytes as two hex digits each, taken in stretches of 1000 so that long texts stay cheap.
SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
p AS (SELECT doc_id, n, 1000 * k AS base, substr(h, 2000 * k + 1, 2198) AS part FROM (SELECT doc_id, h, n, unnest(range(0, n // 1000 + 1)) AS k FROM n)),
w AS (SELECT doc_id, base + i AS i, hash(substr(part, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, base, part, unnest(range(0, least(1000, n - 99 - base))) AS i FROM p)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
e AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
spans AS (SELECT doc_id, min(i) AS start, max(i) + 100 AS stop FROM g GROUP BY doc_id, run),
gaps AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS last FROM spans),
k AS (
    SELECT n.doc_id, count(*) AS n_spans, sum(stop - start) AS n_removed,
        string_agg(substr(h, 2 * last + 1, 2 * (start - last)), '' ORDER BY start) || substr(any_value(h), 2 * max(stop) + 1) AS kept
    FROM gaps JOIN n ON gaps.doc_id = n.doc_id GROUP BY n.doc_id
)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN k ON n.doc_id = k.doc_id
"""

#: CRC32 of a string's bytes, read off its hex digits; ``t`` is the list of the table ``crc_table``.
CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i)))"
DIGIT = "(instr('0123456789ABCDEF', upper(substr({h}, {i}, 1))) - 1)"


def crc(text: str) -> str:
    byte = f"CAST({DIGIT.format(h=f'hex({text})', i='2 * i - 1')} * 16 + {DIGIT.format(h=f'hex({text})', i='2 * i')} AS BIGINT)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen({text}) + 1), lambda i: {byte})), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), CAST(4294967295 AS BIGINT))"


IMPORTANCE = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT {WORDS} AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS x FROM d),
g AS (SELECT unnest(w) AS x FROM b),
k AS (SELECT x, {crc('x')} % 10000 AS bucket FROM (SELECT x FROM f UNION SELECT x FROM g) CROSS JOIN crc_table),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (x) GROUP BY bucket),
n AS (SELECT CAST((SELECT count(*) FROM f) + 10000 AS DOUBLE) AS s_all, CAST((SELECT count(*) FROM g) + 10000 AS DOUBLE) AS t_all),
a AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1e0) * s_all / ((s + 1e0) * t_all))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket) CROSS JOIN n),
e AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN k USING (x) JOIN a USING (bucket) GROUP BY doc_id),
h AS (SELECT doc_id, len(w) AS words, coalesce(weight, 0) AS weight, sha256('2024:' || doc_id) AS x FROM d LEFT JOIN e USING (doc_id)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((list_reduce(list_transform(range(1, 9), lambda i: CAST({DIGIT.format(h='x', i='i')} AS BIGINT)), lambda p, q: p * 16 + q) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE words >= 20)
SELECT y.doc_id, CAST(words AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN CAST(rank AS BIGINT) END AS rank
FROM y LEFT JOIN r ON y.doc_id = r.doc_id
"""


def leaf(text: str) -> str:
    shown = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in shown) + ")"


def grown(name: str, leaves: str) -> str:
    """Levels (tree, level, pos, digest, n) over leaves (tree, pos, digest, n); n: nodes of the level."""
    return f"""{name} AS (
    SELECT tree, 0 AS level, pos, digest, n FROM {leaves}
    UNION ALL
    SELECT tree, max(level) + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, pos // 3
)"""


MANIFEST = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, source, {leaf('text')} AS own, CASE WHEN {crc('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS seen FROM documents CROSS JOIN crc_table),
l AS (SELECT coalesce('.' || source, '') AS tree, source, doc_id, own AS digest, seen, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, own) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
{grown('low', 'l')},
u AS (SELECT tree AS source_tree, '/' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, digest, count(*) OVER () AS n FROM low WHERE n = 1),
{grown('high', 'u')},
k AS (SELECT tree, level, pos // 3 AS run, list(digest ORDER BY pos) AS kids FROM (SELECT * FROM low UNION ALL SELECT * FROM high) WHERE n > 1 GROUP BY ALL),
fold AS (
    SELECT doc_id, tree AS home, tree, 0 AS level, pos, seen AS digest, '' AS proof FROM l
    UNION ALL
    SELECT doc_id, home, tree, level, pos, digest, proof FROM (
        SELECT f.doc_id, f.home, f.tree, f.level + 1 AS level, f.pos // 3 AS pos, sha256(array_to_string(list_transform(kids, lambda x, i: CASE WHEN i = f.pos % 3 + 1 THEN f.digest ELSE x END), '')) AS digest,
            f.proof || coalesce(array_to_string(list_filter(kids, lambda x, i: i <> f.pos % 3 + 1), ''), '') AS proof
        FROM fold f JOIN k ON f.tree = k.tree AND f.level = k.level AND f.pos // 3 = k.run
        UNION ALL
        SELECT f.doc_id, f.home, '/', 0, u.pos, f.digest, f.proof FROM fold f JOIN u ON f.tree = u.source_tree AND f.tree <> '/' WHERE NOT EXISTS (SELECT 1 FROM k WHERE f.tree = k.tree AND f.level = k.level)
    )
),
done AS (SELECT * FROM fold f WHERE tree = '/' AND NOT EXISTS (SELECT 1 FROM k WHERE k.tree = '/' AND f.level = k.level)),
root AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT l.doc_id, l.digest AS leaf, u.digest AS subroot, root, sha256(proof) AS proof_sha256, done.digest AS folded_root, done.digest = root AS verified
FROM l JOIN u ON l.tree = u.source_tree JOIN done ON l.doc_id = done.doc_id AND l.tree = done.home CROSS JOIN root
"""
