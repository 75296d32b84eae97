"""The SQL that says the same as the problems' queries, where it can: by brute force, for small tables."""

from __future__ import annotations

from folioflow.llm.lookalikes import LIGATURES, LOOK_ALIKES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NEIGHBOURS = """
WITH latest AS (
  SELECT row_id, embedding FROM (SELECT row_id, embedding,
    row_number() OVER (PARTITION BY row_id ORDER BY indexed_at DESC NULLS LAST, embedding DESC NULLS LAST) AS rn FROM vectors WHERE row_id IS NOT NULL) WHERE rn = 1),
good AS (
  SELECT row_id, embedding::DOUBLE[] AS e FROM latest WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (
  SELECT a.row_id AS q, b.row_id AS o, row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.row_id) AS rn
  FROM good a JOIN good b ON a.row_id <> b.row_id)
SELECT DISTINCT least(q, o) AS row_id_a, greatest(q, o) AS row_id_b FROM near WHERE rn <= 10
"""

_BLANKS = "               　"
_NOTHING = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{3164}\x{FFA0}\x00-\x08\x0e-\x1f\x7f-\x{84}\x{86}-\x{9f}]"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
_LOOKS = "".join(c for table in LOOK_ALIKES.values() for c in table)
_LIKE = "".join(c for table in LOOK_ALIKES.values() for c in table.values())


def _printed(x: str) -> str:
    x = f"translate(regexp_replace(translate({x}, {_q(_BLANKS)}, {_q(' ' * len(_BLANKS))}), '{_NOTHING}', '', 'g'), {_q(_WIDE)}, {_q(_NARROW)})"
    for ligature, letters in LIGATURES.items():
        x = f"replace({x}, {_q(ligature)}, {_q(letters)})"
    # Composed letters of a look-alike and an accent, in this text the only ones.
    return f"translate(nfc_normalize({x}), {_q(_LOOKS + 'ёЁїЇόέΌΈ')}, {_q(_LIKE + 'ëËïÏóέÓÉ')})"


LOOK_ALIKE = f"""
WITH k AS (
  SELECT DISTINCT 'text' AS field, row_id, '' AS scope, text AS raw, {_printed('text')} AS key FROM passages WHERE text IS NOT NULL
  UNION ALL SELECT DISTINCT 'section', row_id, coalesce(path, ''), section, {_printed('section')} FROM passages WHERE section IS NOT NULL),
v AS (SELECT field, scope, key FROM k GROUP BY ALL HAVING count(DISTINCT raw) > 1), r AS (SELECT k.* FROM k JOIN v USING (field, scope, key))
SELECT DISTINCT a.field, a.row_id AS row_id_a, b.row_id AS row_id_b
FROM r a JOIN r b ON a.field = b.field AND a.scope = b.scope AND a.key = b.key AND a.raw <> b.raw AND a.row_id < b.row_id
"""

#: A run of more than 1,800 characters, written for engines whose repeat counts end at 1,000.
_UNBROKEN = r"[^ \t\n\r]{1000}[^ \t\n\r]{801}"
CUTS = f"""
SELECT DISTINCT item_table, item_id, CASE WHEN regexp_matches(text, '{_UNBROKEN}') THEN 'forced' ELSE 'natural' END AS cut_kind
FROM (SELECT 'docs' AS item_table, load_id AS item_id, text FROM docs WHERE length(text) > 1800
      UNION ALL SELECT 'passages', row_id, text FROM passages WHERE length(text) > 1800)
"""

REVISED = """
WITH r AS (SELECT DISTINCT row_id, path, text FROM passages WHERE text IS NOT NULL),
w AS (SELECT row_id, regexp_extract_all(lower(coalesce(path, '') || ' ' || text), '[a-z0-9]+') AS t FROM r WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) >= 20),
s AS (SELECT DISTINCT row_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS g FROM (SELECT row_id, t, unnest(range(1, len(t) - 1)) AS i FROM w)),
n AS (SELECT row_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.row_id AS x, b.row_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.row_id < b.row_id GROUP BY ALL)
SELECT x AS row_id_a, y AS row_id_b FROM p JOIN n na ON na.row_id = x JOIN n nb ON nb.row_id = y WHERE k >= 0.7 * (na.c + nb.c - k) - 1e-9
"""


_GRAMS = """
WITH RECURSIVE r AS (SELECT DISTINCT row_id, path, text FROM passages WHERE text IS NOT NULL),
w AS (SELECT row_id, regexp_extract_all(lower(coalesce(path, '') || ' ' || text), '[a-z0-9]+') AS t FROM r WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) >= <least>),
s AS (SELECT row_id, array_to_string(t[i : i + <words> - 1], ' ') AS g, count(*) AS c FROM (SELECT row_id, t, unnest(range(1, len(t) - <words> + 2)) AS i FROM w) GROUP BY ALL),
n AS (SELECT row_id, sum(c) AS n, count(*) AS d, md5(string_agg(g || CASE WHEN <multiset> THEN c ELSE 1 END, ',' ORDER BY g)) AS h FROM s GROUP BY 1),
k AS (SELECT row_id, min(row_id) OVER (PARTITION BY h) AS rep, n, d FROM n),
"""


def _grams(words: int, least: int, multiset: bool) -> str:
    return _GRAMS.replace("<words>", str(words)).replace("<least>", str(least)).replace("<multiset>", str(multiset).lower())


MULTISETS = f"""{_grams(5, 0, True)}
f AS (SELECT s.* FROM s JOIN k USING (row_id) WHERE rep = row_id),
p AS (SELECT a.row_id AS x, b.row_id AS y, sum(least(a.c, b.c)) AS o FROM f a JOIN f b ON a.g = b.g AND a.row_id < b.row_id GROUP BY ALL)
SELECT x AS row_id_a, y AS row_id_b, round(o / (a.n + b.n - o), 6) AS similarity FROM p JOIN k a ON a.row_id = x JOIN k b ON b.row_id = y WHERE o >= 0.8 * (a.n + b.n - o) - 1e-9
"""

GROUPS = f"""{_grams(3, 20, False)}
f AS (SELECT s.* FROM s JOIN k USING (row_id) WHERE rep = row_id),
p AS (SELECT a.row_id AS x, b.row_id AS y, count(*) AS o FROM f a JOIN f b ON a.g = b.g AND a.row_id < b.row_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN k a ON a.row_id = x JOIN k b ON b.row_id = y WHERE o >= 0.7 * (a.d + b.d - o) - 1e-9),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT DISTINCT x AS rep, x AS seen FROM e UNION SELECT rep, y FROM reach JOIN e ON seen = x),
g AS (SELECT rep, min(seen) AS low FROM reach GROUP BY 1),
size AS (SELECT rep, count(*) AS size FROM k GROUP BY 1),
o AS (SELECT x AS rep, sum(size) AS others FROM e JOIN size ON rep = y GROUP BY 1)
SELECT row_id, rep AS class_id, least(rep, coalesce(low, rep)) AS group_id, (coalesce(others, 0) + size - 1)::BIGINT AS links
FROM k JOIN size USING (rep) LEFT JOIN o USING (rep) LEFT JOIN g USING (rep)
"""


def _words(x: str) -> str:
    seen = _NOTHING[:-1] + r"*_`~]"
    return rf"regexp_extract_all(nfc_normalize(lower(regexp_replace(translate({x}, {_q(_WIDE)}, {_q(_NARROW)}), '{seen}', '', 'g'))), '[\p{{L}}\p{{M}}\p{{N}}]+')"


LEAKS = f"""
WITH i AS (SELECT DISTINCT item_id, {_words('text')} AS t FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, n, list_aggregate(t[k : k + n - 1], 'string_agg', ' ') AS gram
  FROM (SELECT item_id, t, n, unnest(range(1, len(t) - n + 2)) AS k FROM (SELECT *, least(12, len(t)) AS n FROM i WHERE len(t) > 0))),
d AS (SELECT DISTINCT doc_id, {_words('text')} AS t FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, n, list_aggregate(t[k : k + n - 1], 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g) WHERE len(t) >= n))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (n, gram)
"""

SQL: dict[str, str] = {"p1_found": NEIGHBOURS, "p2_found": LOOK_ALIKE, "p3_found": CUTS, "p5_found": REVISED, "p5_groups": GROUPS, "p5_multiset_links": MULTISETS, "p7_found": LEAKS}
