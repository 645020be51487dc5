"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_low('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
links AS (SELECT a.doc_id AS i, b.doc_id AS j FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS i, doc_id AS j FROM sets UNION SELECT reach.i, links.j FROM reach JOIN links ON reach.j = links.i)
SELECT doc_id, len(any_value(s))::BIGINT AS n_shingles, min(j) AS component_id, doc_id = min(j) AS kept
FROM sets JOIN reach ON doc_id = i GROUP BY doc_id
"""

_CRC = """list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
            lambda x, step: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""

SPELLING = f"""
WITH RECURSIVE crc AS (SELECT {_CRC} AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_low('text')}, '[a-zÀ-ÿ]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY 1, 2),
bytes AS (SELECT own.*, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
                 lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM own),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda h, c: xor(h >> 8, t[(xor(h, c) & 255) + 1]))) AS h FROM bytes, crc),
dropped AS (SELECT n, CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word
            FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM dropped WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS (SELECT word, n, length(word) AS l, i, substring(word, 1, (i - 1)::INT) || substring(word, (i + 1)::INT) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.rest = v.word UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.rest = v.word),
near AS (SELECT x, y, v.n, row_number() OVER (PARTITION BY x ORDER BY v.n DESC, encode(y)) AS place, count(*) OVER (PARTITION BY x) AS n_near
         FROM pairs JOIN v ON y = v.word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near.n >= 5 * v.n THEN y END AS form,
                  CASE WHEN near.n >= 5 * v.n THEN near.n END::BIGINT AS form_n FROM v LEFT JOIN near ON x = v.word AND place = 1),
chain AS (SELECT word, word AS tip FROM formed UNION SELECT chain.word, form FROM chain JOIN formed ON tip = formed.word WHERE form IS NOT NULL)
SELECT f.word, f.form, tip AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain ON chain.word = f.word JOIN formed e ON e.word = tip AND e.form IS NULL
"""

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, {_low('text')} AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
kinds AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY 1),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY 1, 2),
shares AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS p,
                  1 + 1000000000::HUGEINT * (lang_n + 2) // (lang_total + 2 * v) AS q
           FROM totals JOIN kinds USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
         UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM rows)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES = {"op11_minhash_dedup": MINHASH, "op12_spelling_variants": SPELLING, "op13_source_divergence": DIVERGENCE}
