"""The chunking rules in SQL: kinds of lines by windows, headings by level, merging and packing as folds over lists."""

from __future__ import annotations

from folioflow.config import Chunking, Library
from folioflow.operators.chunking import CHAPTER_WORDS, ENTRY_TYPES

#: Names in angle brackets are filled in below.
TEMPLATE = r"""WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, * FROM (
    SELECT DISTINCT coalesce(path, '') AS path, coalesce(doc_id, '') AS doc_id, coalesce(section_prefix, '') AS prefix, text FROM docs WHERE text <> '')),
kinds(folder, kind) AS (VALUES <kinds>),
kd AS (SELECT id, arg_min(kind, pos) AS kind FROM (
  SELECT id, unnest(string_split(path, '/')[:-2]) AS part, generate_subscripts(string_split(path, '/')[:-2], 1) AS pos FROM d) JOIN kinds ON folder = lower(part) GROUP BY 1),
ls AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
lp AS (SELECT *, a + length(line) AS b FROM (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a,
    trim(line, ' ' || chr(9)) AS t, regexp_matches(line, '^#{1,6}[ \t]+[^ \t]') AS hashed FROM ls)),
un AS (SELECT *, lead(t) OVER w AS below, lead(b) OVER w AS below_b, coalesce(trim(lag(line) OVER w), '') = '' AS first,
    bool_or(hashed) OVER (PARTITION BY id) AS any_hash FROM lp WINDOW w AS (PARTITION BY id ORDER BY i)),
ti AS (SELECT *, NOT hashed AND t <> '' AND regexp_matches(coalesce(below, ''), '^(=+|-+)$') AS titled FROM un),
sk AS (SELECT *, coalesce(lag(titled) OVER (PARTITION BY id ORDER BY i), false) AS skipped,
    id IN (SELECT id FROM kd WHERE kind IN (<entry_types>)) AND NOT any_hash AS entries, trim(trim(t, '*_')) AS e FROM ti),
ev AS (SELECT *, CASE WHEN hashed OR titled THEN 'head'
    WHEN entries AND first AND e <> '' AND length(e) <= 70 AND CASE WHEN e LIKE '%:' THEN trim(e[:-2]) <> '' AND NOT contains(e[:-2], ':') AND regexp_matches(e, '^\p{Lu}')
      ELSE NOT contains(e, ':') AND NOT regexp_matches(e, '[.,;!?"]$') AND len(regexp_split_to_array(e, '\s+')) <= 8 AND regexp_matches(e, '(^|\s)\p{L}')
        AND NOT regexp_matches(e, '(^|\s)[\p{Ll}\p{Lo}\p{Lm}]') END THEN 'entry'
    WHEN regexp_matches(t, '^((\*[ \t]*){3,}|#|[-_~=]{3,}|§+|<>|\.{4,})$') THEN 'break'
    WHEN t <> '' AND first AND length(t) <= 80 AND NOT regexp_matches(t, '[.,;!?]$') AND (regexp_matches(t, '(?i)^(<chapters>)\b')
      OR (length(t) <= 60 AND coalesce(below, '') = '' AND t = upper(t) AND t <> lower(t))) THEN 'chapter' END AS what FROM sk WHERE NOT skipped),
pt AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY a) AS n, a, what, CASE WHEN titled THEN below_b + 1 WHEN what = 'entry' THEN a ELSE b + 1 END AS s,
    CASE WHEN hashed THEN length(regexp_extract(line, '^#+')) WHEN titled THEN CASE WHEN below LIKE '=%' THEN 1 ELSE 2 END WHEN what <> 'break' THEN 1 END AS level,
    CASE WHEN hashed THEN rtrim(rtrim(regexp_replace(t, '^#+[ \t]+', ''), '#'), ' ' || chr(9)) WHEN what = 'entry' THEN rtrim(e, ':') ELSE t END AS title FROM ev WHERE what IS NOT NULL),
st AS (SELECT *, <levels> FROM pt WINDOW w AS (PARTITION BY id ORDER BY n)),
se AS (SELECT id, n, s, coalesce(lead(a) OVER (PARTITION BY id ORDER BY n), length(text)) AS e, p, text FROM (
  SELECT id, n, s, a, <paths> AS p FROM st UNION ALL SELECT id, 0, 0, -1, []::VARCHAR[] FROM d) JOIN d USING (id)),
sf AS (SELECT *, NOT regexp_matches(chr(10) || substr(text, prev + 1, s - prev), '\n[ \t]*([^# \t\n]|#+[^# \t\n]|#+[ \t]*(\n|$)|#{7})') AS bridged FROM (
  SELECT *, coalesce(lag(e) OVER (PARTITION BY id ORDER BY n), 0) AS prev FROM se WHERE e > s AND regexp_matches(substr(text, s + 1, e - s), '\S'))),
ss AS (SELECT id, list([struct_pack(s := s, e := e, bridged := bridged, p := p)] ORDER BY n) AS ss FROM sf GROUP BY 1),
mg AS (SELECT id, unnest(CASE WHEN id IN (SELECT id FROM sk WHERE entries) THEN flatten(ss) ELSE list_reduce(ss, lambda acc, x:
    CASE WHEN x[1].bridged AND coalesce(acc[-1].p[1], '') = coalesce(x[1].p[1], '') AND x[1].e - acc[-1].s <= <target>
    THEN list_concat(acc[:-2], [struct_pack(s := acc[-1].s, e := x[1].e, bridged := acc[-1].bridged,
      p := list_filter(acc[-1].p, lambda v, k: acc[-1].p[:k] = x[1].p[:k]))]) ELSE list_concat(acc, x) END) END) AS m FROM ss),
sn AS (SELECT row_number() OVER () AS sid, id, m.s AS s, m.e AS e, array_to_string(list_filter([prefix, array_to_string(m.p, ' > ')], lambda x: x <> ''), ' > ') AS section,
    substr(text, m.s + 1, m.e - m.s) AS body FROM mg JOIN d USING (id)),
pq AS (SELECT sid, s, CASE WHEN e - s <= <most> THEN [body] ELSE regexp_extract_all(body, '(?s)(.*?\n[ \t]*\n|.+$)') END AS q FROM sn),
pa AS (SELECT sid, s, unnest(q) AS x, generate_subscripts(q, 1) AS k FROM pq),
par AS (SELECT sid, k, x, s + coalesce(sum(length(x)) OVER (PARTITION BY sid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM pa),
sq AS (SELECT sid, k, a, CASE WHEN length(x) <= <most> THEN [x] ELSE list_reduce(list_transform(regexp_extract_all(x, '(?s)(.*?[.!?]["''’”)\]]*\s+|.+$)'), lambda y: [y]),
    lambda acc, y: CASE WHEN length(acc[-1]) + length(y[1]) <= <target> THEN list_concat(acc[:-2], [acc[-1] || y[1]]) ELSE list_concat(acc, y) END) END AS q FROM par),
sr AS (SELECT sid, k, a, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM sq),
run AS (SELECT sid, x, a + coalesce(sum(length(x)) OVER (PARTITION BY sid, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM sr),
pc AS (SELECT sid, a, x, -1::BIGINT AS b FROM run UNION ALL
  SELECT sid, unnest(CASE WHEN b >= 0 THEN [b] ELSE [a, stop + gap] END) AS a, unnest(CASE WHEN b >= 0 THEN [x] ELSE ['', substr(x, stop - a + gap + 1)] END) AS x,
    unnest(CASE WHEN b >= 0 THEN [b] ELSE [stop, -1] END) AS b FROM (
    SELECT sid, a, x, b, CASE WHEN contains(w, ' ') THEN 1 ELSE 0 END AS gap, a + <half> + length(CASE WHEN contains(w, ' ') THEN regexp_extract(w, '(?s)^(.*) ', 1) ELSE w END) AS stop FROM (
      SELECT sid, a, x, b, substr(x, <half> + 1, <most> - <half>) AS w FROM pc WHERE b < 0 AND length(x) > <most>))),
pcs AS (SELECT sid, a, CASE WHEN b < 0 THEN a + length(x) ELSE b END AS b FROM pc WHERE b >= 0 OR (length(x) <= <most> AND x <> '')),
pk AS (SELECT sid, unnest(list_reduce(list([struct_pack(a := a, b := b)] ORDER BY a), lambda acc, x: CASE WHEN x[1].b - acc[-1].a <= <target>
    THEN list_concat(acc[:-2], [struct_pack(a := acc[-1].a, b := x[1].b)]) ELSE list_concat(acc, x) END)) AS m FROM pcs GROUP BY 1),
ob AS (SELECT sid, id, section, m.a AS a, m.b AS b, s, body, min(m.a) OVER (PARTITION BY sid) AS first_a, greatest(s, m.a - <overlap>) AS back FROM pk JOIN sn USING (sid)),
ov AS (SELECT *, substr(body, back - s + 1, a - back) AS reach FROM ob),
oa AS (SELECT id, section, s, body, b, CASE WHEN a = first_a THEN a WHEN contains(reach, ' ') THEN back + strpos(reach, ' ') ELSE back END AS a FROM ov),
tr AS (SELECT id, section, a, substr(body, a - s + 1, b - a) AS x FROM oa)
SELECT path, doc_id, section, (a + length(x) - length(ltrim(x, chr(10))))::INT AS start_pos, (a + length(rtrim(x, chr(10))))::INT AS end_pos, length(trim(x, chr(10)))::INT AS chars
FROM tr JOIN d USING (id) WHERE length(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')) >= 3 GROUP BY ALL"""


def chunk_sql(c: Chunking = Chunking()) -> str:
    def level(k: int) -> str:
        higher = ", ".join(f"coalesce(h{j}.n, -1)" for j in range(1, k))
        return f"CASE WHEN h{k}.n > {f'greatest({higher})' if k > 2 else higher or '-1'} THEN [h{k}.t] ELSE []::VARCHAR[] END"

    filled = {
        "kinds": ", ".join(f"('{f}', '{k}')" for f, k in Library().folders.items()),
        "entry_types": ", ".join(f"'{x}'" for x in ENTRY_TYPES),
        "chapters": "|".join(CHAPTER_WORDS),
        "levels": ", ".join(f"max(CASE WHEN level = {k} THEN struct_pack(n := n, t := title) END) OVER w AS h{k}" for k in range(1, 7)),
        "paths": f"flatten([{', '.join(map(level, range(1, 7)))}])",
        "target": str(c.target_chars), "half": str(c.target_chars // 2), "most": str(c.max_chars), "overlap": str(c.overlap_chars),
    }
    sql = TEMPLATE
    for name, value in filled.items():
        sql = sql.replace(f"<{name}>", value)
    return sql
