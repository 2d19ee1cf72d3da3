"""The collocation query as DuckDB SQL."""

PHRASES_SQL = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS doc
    FROM documents WHERE text IS NOT NULL
),
pieces AS (SELECT lang, doc, unnest(parts) AS piece, generate_subscripts(parts, 1) AS no FROM (SELECT *, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS parts FROM texts)),
words AS (
    SELECT * FROM (
        SELECT lang, doc, no, unnest(parts) AS w1, generate_subscripts(parts, 1) AS pos
        FROM (SELECT *, regexp_split_to_array(piece, '[\x20\x09]+') AS parts FROM pieces)
    ) WHERE w1 <> ''
),
following AS (
    SELECT lang, w1, lead(w1, 1) OVER w AS w2, lead(w1, 2) OVER w AS w3, lead(w1, 3) OVER w AS w4
    FROM words WINDOW w AS (PARTITION BY doc, no ORDER BY pos)
),
counts AS (
    SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM following GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM following WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM following WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM following WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
),
totals AS (SELECT lang, count(*) AS n FROM following GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (
    SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
    JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
cover AS (
    SELECT lang, phrase, max(a) AS most FROM (
        SELECT lang, a, array_to_string(w[i:i + size - 1], ' ') AS phrase
        FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM candidates WHERE k > 2))
    ) GROUP BY ALL
),
ranked AS (
    SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, score
    FROM worst w LEFT JOIN cover USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
