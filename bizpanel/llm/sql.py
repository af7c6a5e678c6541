"""DuckDB SQL of the queries that SQL can state over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BENCHMARK_WORDS = r"""
    string_split_regex(trim(regexp_replace(translate(coalesce({text}, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ')
"""


def _split(text: str) -> str:
    return _BENCHMARK_WORDS.format(text=text)


OP8 = f"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter({_split("text")}, lambda x: x <> '') AS w
    FROM documents
), item AS (
    SELECT item_id, list_filter({_split("text")}, lambda x: x <> '') AS w FROM benchmark
), item_window AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n,
        array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS phrase
    FROM item, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS t(s)
    WHERE len(w) > 0
), doc_window AS (
    SELECT r, s, n, array_to_string(w[s + 1 : s + n], ' ') AS phrase
    FROM doc, (SELECT DISTINCT n FROM item_window) AS sizes, unnest(range(0, len(w) - n + 1)) AS t(s)
    WHERE len(w) >= n
), hit AS (
    SELECT r, s, d.n, item_id FROM doc_window AS d JOIN item_window AS i USING (phrase)
    WHERE d.n = i.n
), words_hit AS (
    SELECT r, count(DISTINCT s + k) AS n_hit FROM hit, unnest(range(0, n)) AS t(k) GROUP BY r
), items_hit AS (
    SELECT r, count(DISTINCT item_id) AS n_items,
        sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',')) AS h
    FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words_hit USING (r) LEFT JOIN items_hit USING (r)
"""

OP10 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, p.vec_id,
        CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(p.c AS DOUBLE[])) AS BIGINT) AS score
    FROM v AS q, v AS p
    WHERE q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

_SPACED = r"string_split_regex(trim(regexp_replace({text}, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ')"

OP4 = f"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id,
        list_filter({_SPACED.format(text="coalesce(text, '')")}, lambda x: x <> '') AS w
    FROM documents
), win AS (
    SELECT r, doc_id, s, array_to_string(w[s + 1 : s + 13], ' ') AS phrase
    FROM doc, unnest(range(0, len(w) - 12)) AS t(s)
    WHERE len(w) >= 13 AND doc_id IS NOT NULL
), judged AS (
    SELECT r, s FROM (SELECT r, s, doc_id, min(doc_id) OVER (PARTITION BY phrase) AS first_id FROM win)
    WHERE doc_id > first_id
), gone AS (
    SELECT DISTINCT r, s + k AS i FROM judged, unnest(range(0, 13)) AS t(k)
), word AS (
    SELECT r, i, w[i + 1] AS x FROM doc, unnest(range(0, len(w))) AS t(i)
), kept AS (
    SELECT r, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM word ANTI JOIN gone USING (r, i)
    GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)
"""

_SHINGLED = _SPACED.format(
    text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
)

OP7 = f"""
WITH RECURSIVE doc AS (
    SELECT doc_id, list_filter({_SHINGLED}, lambda x: x <> '') AS w FROM documents
), grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[s + 1 : s + least(len(w), 5)], ' ') AS g
    FROM doc, unnest(range(0, greatest(len(w) - 4, 1))) AS t(s)
    WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), met AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
    FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id
), link AS (
    SELECT x, y FROM met JOIN sizes AS p ON p.doc_id = x JOIN sizes AS q ON q.doc_id = y
    WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), edge AS (
    SELECT x, y FROM link UNION SELECT y, x FROM link
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM doc
    UNION
    SELECT reach.a, edge.y FROM reach JOIN edge ON edge.x = reach.b
)
SELECT doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id
FROM doc LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = doc.doc_id
GROUP BY doc_id
"""

_FIELD = "coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    names = ("doc_id", "source", "lang", n_chars, "text")
    return f"sha256({' || '.join(_FIELD.format(c=c) for c in names)})"


#: The CRC of ``s``, bit by bit.
_CRC = """
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
            list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], CAST(range(8) AS BIGINT[])),
            lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)
"""

_LEVEL = """
    SELECT {keys}, k + 1, list_transform(range(0, (len(nodes) + 1) // 2),
        lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
    FROM {name} WHERE len(nodes) > 1
"""

OP12 = f"""
WITH RECURSIVE doc AS (
    SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS altered,
        coalesce(CAST(doc_id AS VARCHAR), '') AS s
    FROM documents
), leaves AS (
    SELECT lang, doc_id, leaf,
        CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN altered ELSE leaf END AS claimed,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
        row_number() OVER () AS r
    FROM doc
), tree AS (
    SELECT lang, 0 AS k, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY lang
    UNION ALL
{_LEVEL.format(keys="lang", name="tree")}
), subroots AS (
    SELECT lang, k AS height, nodes[1] AS subroot,
        row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place
    FROM tree WHERE len(nodes) = 1
), top AS (
    SELECT 0 AS forest, 0 AS k, list(subroot ORDER BY place) AS nodes FROM subroots
    UNION ALL
{_LEVEL.format(keys="forest", name="top")}
), step AS (
    SELECT r, tree.k AS k, place >> tree.k AS p, nodes
    FROM leaves JOIN tree ON leaves.lang IS NOT DISTINCT FROM tree.lang WHERE len(nodes) > 1
    UNION ALL
    SELECT r, height + top.k, s.place >> top.k, nodes
    FROM leaves JOIN subroots AS s ON leaves.lang IS NOT DISTINCT FROM s.lang, top WHERE len(nodes) > 1
), path AS (
    SELECT r, list(CASE WHEN p % 2 = 1 THEN nodes[p] || '|' ELSE '|' || coalesce(nodes[p + 2], '') END
        ORDER BY k) AS steps
    FROM step GROUP BY r
), folded AS (
    SELECT l.*, s.subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root,
        sha256(replace(array_to_string(coalesce(steps, []), ''), '|', '')) AS proof_sha256,
        list_reduce(list_concat([claimed], coalesce(steps, [])), lambda x, step:
            sha256(string_split(step, '|')[1] || x || string_split(step, '|')[2])) AS folded_root
    FROM leaves AS l JOIN subroots AS s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN path USING (r)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

_PIECES = rf"""
    string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')
"""

OP13 = f"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest({_PIECES}) AS piece FROM documents
), spoken AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece
), size AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM spoken GROUP BY lang
), phrase AS (
    SELECT lang, m, array_to_string(w[i + 1 : i + m], ' ') AS phrase, count(*) AS a
    FROM spoken, unnest(range(1, 6)) AS t(m), unnest(range(0, len(w) - m + 1)) AS u(i)
    WHERE len(w) >= m GROUP BY ALL HAVING count(*) >= 100
), cut AS (
    SELECT p.lang, p.phrase, p.m, p.a, k, f.a AS l, r.a AS r, n,
        CAST(1000 * CAST(p.a AS HUGEINT) * n // (CAST(f.a AS HUGEINT) * r.a) AS BIGINT) AS score
    FROM phrase AS p JOIN size USING (lang), unnest(range(1, p.m)) AS t(k)
    JOIN phrase AS f ON f.lang = p.lang AND f.phrase = array_to_string(string_split(p.phrase, ' ')[1 : k], ' ')
    JOIN phrase AS r ON r.lang = p.lang AND r.phrase = array_to_string(string_split(p.phrase, ' ')[k + 1 :], ' ')
), lowest AS (
    SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), free AS (
    SELECT * FROM lowest AS s WHERE NOT EXISTS (
        SELECT 1 FROM phrase AS g WHERE g.lang = s.lang AND g.m > s.m AND g.a >= s.a
            AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM free
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))
QUALIFY row_number() OVER w <= 2000
"""

ORACLES = {
    "op4_substring_dedup": OP4,
    "op7_jaccard_join": OP7,
    "op8_decontamination": OP8,
    "op10_topk": OP10,
    "op12_merkle_manifest": OP12,
    "op13_collocations": OP13,
}
