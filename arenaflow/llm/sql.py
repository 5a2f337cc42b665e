"""SQL over the given tables for the operators that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    parts = " || ".join(f"coalesce(strlen({field}::VARCHAR) || ':' || {field}::VARCHAR, '-')" for field in fields)
    return f"sha256({parts})"


_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                               lambda x, turn: xor(x >> 1, 3988292384 * (x & 1)))))"""

MERKLE_MANIFEST = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce(':' || source, '') AS tree, {_leaf("text")} AS digest,
           CASE WHEN {_CRC32} % 5 = 0 THEN {_leaf(_LOWER.format("text"))} END AS claimed
    FROM documents),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS number,
           count(*) OVER (PARTITION BY tree) AS size
    FROM leaves),
nodes(tree, level, number, size, digest) AS (
    SELECT tree, 0::BIGINT, number, size, digest FROM numbered
    UNION ALL
    SELECT tree, level + 1, number // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY number))
    FROM nodes WHERE size > 1 GROUP BY tree, level, number // 16, size),
subroots AS (
    SELECT tree, level AS height, digest, row_number() OVER (ORDER BY tree) - 1 AS number, count(*) OVER () AS size
    FROM nodes WHERE size = 1),
upper_nodes(level, number, size, digest) AS (
    SELECT 0::BIGINT, number, size, digest FROM subroots
    UNION ALL
    SELECT level + 1, number // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY number))
    FROM upper_nodes WHERE size > 1 GROUP BY level, number // 16, size),
every AS (
    SELECT tree, level, number, digest FROM nodes WHERE size > 1
    UNION ALL
    SELECT NULL, level, number, digest FROM upper_nodes WHERE size > 1),
siblings AS (
    SELECT mine.tree, mine.level, mine.number,
           coalesce(string_agg(other.digest, '' ORDER BY other.number) FILTER (WHERE other.number < mine.number), '') AS before,
           coalesce(string_agg(other.digest, '' ORDER BY other.number) FILTER (WHERE other.number > mine.number), '') AS after
    FROM every AS mine JOIN every AS other ON mine.tree IS NOT DISTINCT FROM other.tree AND mine.level = other.level
         AND mine.number // 16 = other.number // 16
    GROUP BY mine.tree, mine.level, mine.number),
folded(doc_id, tree, number, leaf, digest, proof, step) AS (
    SELECT doc_id, tree, number, digest, coalesce(claimed, digest), '', 0::BIGINT FROM numbered
    UNION ALL
    SELECT folded.doc_id, folded.tree, folded.number, leaf,
           sha256(before || folded.digest || after), proof || before || after, step + 1
    FROM folded JOIN subroots ON folded.tree = subroots.tree JOIN siblings ON CASE
        WHEN step < height THEN siblings.tree = folded.tree AND siblings.level = step
             AND siblings.number = folded.number // (16 ** step)::BIGINT
        ELSE siblings.tree IS NULL AND siblings.level = step - height
             AND siblings.number = subroots.number // (16 ** (step - height))::BIGINT END)
SELECT doc_id, leaf, subroots.digest AS subroot, top.digest AS root, sha256(proof) AS proof_sha256,
       folded.digest AS folded_root, folded.digest = top.digest AS verified
FROM folded JOIN subroots ON folded.tree = subroots.tree
     JOIN (SELECT digest, level FROM upper_nodes WHERE size = 1) AS top ON step = height + top.level
"""

CHOSEN_PATH_GROUPS = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1
        THEN list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]) ELSE w END) AS shingle
    FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT one.doc_id AS a, two.doc_id AS b
    FROM shingles AS one JOIN shingles AS two ON one.shingle = two.shingle AND one.doc_id < two.doc_id
         JOIN sizes AS s ON s.doc_id = one.doc_id JOIN sizes AS t ON t.doc_id = two.doc_id
    WHERE 100 * least(s.n, t.n) >= 80 * greatest(s.n, t.n)
    GROUP BY one.doc_id, two.doc_id, s.n, t.n HAVING 100 * count(*) >= 80 * (s.n + t.n - count(*))),
reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reached.doc_id, CASE WHEN links.a = reached.other THEN links.b ELSE links.a END
    FROM reached JOIN links ON links.a = reached.other OR links.b = reached.other),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM lowest LEFT JOIN sizes USING (doc_id)
"""

PHRASE_COLLOCATIONS = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda p: array_to_string(w[p:p + size - 1], ' '))) AS phrase
    FROM words, range(1, 5) AS sizes(size)),
counts AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY lang, size, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 30),
cuts AS (
    SELECT c.lang, c.phrase, c.a, c.w, k, l.f AS l, r.f AS r, (2000000 * c.a) // (l.f + r.f) AS score
    FROM candidates AS c, range(1, 4) AS ks(k)
         JOIN counts AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
         JOIN counts AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
    WHERE k < c.size),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, array_to_string(w[p:p + width - 1], ' ') AS phrase, max(a) AS longer
    FROM candidates, range(2, 4) AS widths(width), range(1, 4) AS starts(p)
    WHERE width < size AND p + width - 1 <= size GROUP BY 1, 2),
kept AS (
    SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase)
    WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
