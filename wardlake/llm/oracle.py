"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE CAST(strlen({text}) AS VARCHAR) || ':' || {text} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32 of a decimal number: each byte is taken into the register, then eight shifts by the reversed polynomial.
_CRC32 = """
    xor(list_reduce(
        list_concat([4294967295::BIGINT], flatten(list_transform(
            string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]))),
        lambda crc, step: CASE WHEN step >= 256 THEN xor(crc, step - 256)
            WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295)
"""

MERKLE = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf,
        CASE WHEN ({_CRC32}) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claimed
    FROM documents
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
    FROM leaves
),
nodes AS (
    SELECT tree, 0 AS lvl, pos, leaf AS digest, n FROM placed
    UNION ALL
    SELECT tree, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3)
    FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 3
),
subroots AS (
    SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n
    FROM nodes WHERE n = 1
),
upper AS (
    SELECT 0 AS lvl, place AS pos, subroot AS digest, n FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3)
    FROM upper WHERE n > 1 GROUP BY lvl, pos // 3
),
sides AS (
    SELECT tree, lvl, pos, n,
        coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM (SELECT tree, lvl, pos, digest, n FROM nodes UNION ALL SELECT NULL, lvl, pos, digest, n FROM upper)
    WHERE n > 1
    WINDOW run AS (PARTITION BY tree, lvl, pos // 3 ORDER BY pos)
),
climb AS (
    SELECT doc_id, leaf, tree AS home, tree, 0 AS lvl, pos, claimed AS digest, '' AS proof FROM placed
    UNION ALL
    SELECT doc_id, leaf, home, s.tree, c.lvl + 1, s.pos // 3, sha256(s.l || c.digest || s.r), c.proof || s.l || s.r
    FROM climb c JOIN sides s ON s.tree = c.tree AND s.lvl = c.lvl AND s.pos = c.pos
),
tops AS (
    SELECT c.*, s.subroot, s.place FROM climb c JOIN subroots s ON s.tree = c.home
    JOIN (SELECT tree, max(lvl) AS lvl FROM nodes GROUP BY tree) h ON h.tree = c.home AND h.lvl = c.lvl
),
climb_upper AS (
    SELECT doc_id, leaf, subroot, 0 AS lvl, place AS pos, digest, proof FROM tops
    UNION ALL
    SELECT doc_id, leaf, subroot, c.lvl + 1, s.pos // 3, sha256(s.l || c.digest || s.r), c.proof || s.l || s.r
    FROM climb_upper c JOIN sides s ON s.tree IS NULL AND s.lvl = c.lvl AND s.pos = c.pos
)
SELECT doc_id, leaf, subroot, digest_of_root AS root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = digest_of_root AS verified
FROM climb_upper, (SELECT digest AS digest_of_root, lvl AS top FROM upper WHERE n = 1)
WHERE lvl = top
"""

#: The template's marks have 15, 13 and 7 characters for system, user and assistant; a named role stands in both of its own.
CHAT = r"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
turns AS (
    SELECT *, row_number() OVER said AS place, lag(role) OVER said AS earlier,
        length(text) - length(translate(text, '\[<', '')) AS escapes,
        length(role) + length(role) - length(translate(role, '\[<|', '')) AS named
    FROM given
    WINDOW said AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(text) + escapes + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 9 + 2 * named END) AS BIGINT) AS formatted_chars,
    bool_and(CASE WHEN earlier IS NULL THEN role IN ('system', 'user') WHEN earlier IN ('system', 'assistant') THEN role = 'user'
        WHEN earlier = 'user' THEN role = 'assistant' ELSE false END) AS valid
FROM turns GROUP BY conv_id
"""

#: Distinct sets meet where their rarest shingles do; 80 of 100 leave no pair out that has none of them in common.
JACCARD = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
    FROM words
),
entities AS (SELECT s, len(s) AS n, min(doc_id) AS name FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT name, n, unnest(s) AS shingle FROM entities),
ranked AS (
    SELECT name, n, shingle, row_number() OVER (PARTITION BY name ORDER BY f, shingle) AS place
    FROM items JOIN (SELECT shingle, count(*) AS f FROM items GROUP BY shingle) USING (shingle)
),
rare AS (SELECT * FROM ranked WHERE place <= n - (80 * n + 99) // 100 + 1),
met AS (
    SELECT DISTINCT a.name AS one, b.name AS two FROM rare a JOIN rare b ON a.shingle = b.shingle AND a.name < b.name
    WHERE 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
),
shared AS (
    SELECT one, two, a.n + b.n AS both_sizes, len(list_intersect(a.s, b.s)) AS common
    FROM met JOIN entities a ON a.name = one JOIN entities b ON b.name = two
),
links AS (
    SELECT one, two FROM shared WHERE 100 * common >= 80 * (both_sizes - common)
    UNION SELECT two, one FROM shared WHERE 100 * common >= 80 * (both_sizes - common)
),
reached AS (
    SELECT name AS start, name AS here FROM entities
    UNION SELECT start, two FROM reached JOIN links ON one = here
),
named AS (SELECT start, min(here) AS component FROM reached GROUP BY start)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM sets LEFT JOIN entities ON entities.s = sets.s LEFT JOIN named ON start = name
"""

ORACLE_SQL: dict[str, str] = {"op6_jaccard_join": JACCARD, "op10_chat_formatting": CHAT, "op13_merkle_manifest": MERKLE}
