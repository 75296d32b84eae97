"""The SQL that says the same as the core's queries, for a check on another engine."""

from __future__ import annotations

import unicodedata

from folioflow import queries as Q
from folioflow.config import Library, Prompt, Retrieval
from folioflow.functions import text as T
from folioflow.operators.answering import KEPT_CHARS, KEPT_MESSAGES, PRONOUNS
from folioflow.operators.lexicon import B, K1
from folioflow.oracle_chunks import chunk_sql


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: What composition turns into one other character, apart from canonical equivalents; by rule.
_STYLED = [c for c in map(chr, range(0xA0, 0x30000)) if len(k := unicodedata.normalize("NFKC", c)) == 1 and k != c == unicodedata.normalize("NFC", c)]
_UNSTYLED = [unicodedata.normalize("NFKC", c) for c in _STYLED]


def fold(x: str) -> str:
    x = f"nfc_normalize(translate({x}, {quoted(''.join(_STYLED))}, {quoted(''.join(_UNSTYLED))}))"
    return f"replace(translate({x}, {quoted(T.FOLD_FROM)}, {quoted(T.FOLD_TO)}), '…', '...')"


P4 = r"""
WITH m AS (
  SELECT snapshot_no, delivery_no, regexp_replace(replace(path, '\', '/'), '^\./', '') AS path,
         lower(trim(hash, ' ')) AS h, size, mtime
  FROM manifest WHERE path IS NOT NULL AND snapshot_no IS NOT NULL),
last AS (SELECT snapshot_no, max(delivery_no) AS delivery_no FROM m GROUP BY 1),
steps AS (SELECT snapshot_no, delivery_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev FROM last),
one AS (
  SELECT snapshot_no, path, h, size, mtime FROM (
    SELECT m.*, row_number() OVER (PARTITION BY m.snapshot_no, path
      ORDER BY mtime DESC NULLS LAST, h DESC NULLS LAST, size DESC NULLS LAST) AS rn
    FROM m JOIN last USING (snapshot_no, delivery_no)) WHERE rn = 1),
pairs AS (
  SELECT s.snapshot_no, p.path FROM steps s JOIN (SELECT DISTINCT snapshot_no, path FROM one) p
    ON p.snapshot_no IN (s.snapshot_no, s.prev) WHERE s.prev IS NOT NULL GROUP BY ALL),
sides AS (
  SELECT q.snapshot_no, q.path, n.path IS NOT NULL AS has_n, o.path IS NOT NULL AS has_o,
         n.h AS nh, o.h AS oh, n.size AS ns, o.size AS os, n.mtime AS nm, o.mtime AS om
  FROM pairs q JOIN steps s USING (snapshot_no)
  LEFT JOIN one n ON n.snapshot_no = q.snapshot_no AND n.path = q.path
  LEFT JOIN one o ON o.snapshot_no = s.prev AND o.path = q.path),
kinds AS (
  SELECT snapshot_no, path, CASE WHEN NOT has_o THEN 'added' WHEN NOT has_n THEN 'removed'
    WHEN nh IS NOT NULL AND oh IS NOT NULL THEN CASE WHEN nh <> oh THEN 'changed' END
    WHEN ns IS DISTINCT FROM os OR coalesce(abs(nm - om) > 1.0, false) THEN 'changed' END AS change_kind
  FROM sides)
SELECT snapshot_no, path, change_kind FROM kinds WHERE change_kind IS NOT NULL
"""

CORPUS = f"""corpus AS (
  SELECT doc_id AS row_id, source AS path, coalesce(doc_type, 'other') AS doc_type,
         concat(coalesce(title, ''), chr(10), chr(10), coalesce(text, '')) AS body FROM documents),
formed AS (SELECT row_id, path, doc_type, lower({fold('body')}) AS form FROM corpus),
words AS (
  SELECT row_id, path, doc_type, form, list_transform(regexp_extract_all(form, '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)*'),
    lambda x: replace(regexp_replace(x, '''s$', ''), '''', '')) AS tokens FROM formed)"""

_NAMES = ", ".join(map(quoted, Q.NAMES))
FIXED_NAMES = f"SELECT [{_NAMES}]"
POSTED = f"{CORPUS}, posted AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(tokens) AS term FROM words) GROUP BY ALL)"
STATS = "stats AS (SELECT count(*) AS n, greatest(avg(len(tokens)), 1.0) AS avgdl FROM words)"


def bm25(terms: list[str]) -> str:
    return f"""{POSTED}, {STATS},
hits AS (SELECT * FROM posted WHERE term IN ({", ".join(map(quoted, terms))})),
freq AS (SELECT term, count(*) AS df FROM hits GROUP BY 1),
bm AS (
  SELECT h.row_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * len(tokens) / avgdl))) AS literal
  FROM hits h JOIN freq USING (term) JOIN words w ON w.row_id = h.row_id, stats GROUP BY 1)"""


BM25 = bm25(Q.TERMS)
#: The words of the question that may be names, by the rules that need the corpus: rare, or capitalised within the question.
_ASKED = [(i, t, raw[0].isupper() and i > 0) for i, (t, raw) in enumerate(T.query_terms(Q.QUESTION)) if t not in T.COMMON_WORDS]
ASKED_NAMES = f"""SELECT list(term ORDER BY i) FROM (VALUES {", ".join(f"({i}, {quoted(t)}, {cap})" for i, t, cap in _ASKED)}) v(i, term, cap)
  JOIN freq USING (term), stats WHERE cap OR df <= greatest(3, floor(n * 0.01))"""
ASKED_TERMS = list(dict.fromkeys(t for t, _ in T.query_terms(Q.QUESTION)))


def ranked(
    names: str | None, bonuses: dict[str, float], phrase: str | None, vector: bool, types: tuple[str, ...] = (), k: int = 0, cap: int = 0,
    terms: list[str] = Q.TERMS, shown: bool = False,
) -> str:
    r = Retrieval()
    ws, wl = r.weights() if vector else (0.0, 1.0)
    bonus = " + ".join(f"CASE WHEN doc_type = {quoted(t)} THEN {x} ELSE 0 END" for t, x in bonuses.items()) or "0"
    boost = f"len(list_intersect(tokens, nl)) / greatest(1, len(nl))::DOUBLE * {r.proper_noun_boost}" if names else "0"
    where = f"WHERE doc_type IN ({', '.join(map(quoted, types))})" if types else ""
    hit = f"contains(form, {quoted(phrase)})" if phrase else "false"
    semantic = "coalesce(list_dot_product(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 0)" if vector else "0.0"
    matched = ", array_to_string(list_filter(nl, lambda x: contains(form, x)), ' ') AS names" if shown else ""
    return f"""WITH {bm25(terms)},
nt AS (SELECT ({names or "SELECT []::VARCHAR[]"}) AS nl),
base AS (
  SELECT w.row_id, w.path, w.doc_type, w.form, coalesce(bm.literal, 0) AS literal, {boost} AS boost, {semantic} AS semantic, nl
  FROM words w LEFT JOIN bm USING (row_id) LEFT JOIN embeddings e ON e.vec_id = w.row_id, nt),
bounds AS (SELECT min(semantic) s0, max(semantic) s1, min(literal) l0, max(literal) l1 FROM base),
scored AS (
  SELECT row_id, path, doc_type, form, nl, {ws} * CASE WHEN s1 - s0 < 1e-9 THEN 0 ELSE (semantic - s0) / (s1 - s0) END
    + {wl} * CASE WHEN l1 - l0 < 1e-9 THEN 0 ELSE (literal - l0) / (l1 - l0) END + boost + {bonus} AS score FROM base, bounds),
short AS (SELECT * FROM scored {where} ORDER BY score DESC, row_id LIMIT {r.candidates}),
phrased AS (SELECT row_id, path, form, nl, {hit} AS phrase_hit, score + CASE WHEN {hit} THEN {r.phrase_boost} ELSE 0 END AS score FROM short),
capped AS (SELECT *, (row_number() OVER (PARTITION BY path ORDER BY score DESC, row_id) > {cap or r.max_per_file})::INT AS tier FROM phrased)
SELECT row_id, path, tier, round(score, 6) AS score, phrase_hit{matched} FROM capped ORDER BY tier, capped.score DESC, row_id LIMIT {k or r.k}"""


_KINDS = ", ".join(f"({quoted(f)}, {quoted(k)})" for f, k in Library().folders.items())


def offset_form(x: str) -> str:
    form = f"lower(translate({x}, {quoted(''.join(T.FOLDS))}, {quoted(''.join(T.FOLDS.values()))}))"
    return f"CASE WHEN length({form}) = length({x}) THEN {form} ELSE {x} END"


def places(needle: str, where: str = "true") -> str:
    n = quoted(needle.lower())
    return f"""rows_ AS (SELECT DISTINCT row_id, path, doc_id, coalesce(start_pos, 0) AS base, {offset_form('text')} AS form FROM passages WHERE text IS NOT NULL AND {where}),
holding AS (SELECT * FROM rows_ WHERE contains(form, {n})),
cut AS (SELECT row_id, path, doc_id, base, form, unnest(range(1, length(form) - {len(needle)} + 2)) AS i FROM holding),
hit AS (SELECT row_id, path, doc_id, i - 1 AS local, base + i - 1 AS position FROM cut WHERE substr(form, i, {len(needle)}) = {n}),
found AS (SELECT row_id, path, doc_id, local::INT AS local, position::INT AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY path, doc_id, position ORDER BY row_id, local) AS rn FROM hit) WHERE rn = 1)"""


STATES = r"""m AS (
  SELECT snapshot_no, delivery_no, regexp_replace(replace(path, '\', '/'), '^\./', '') AS path, lower(trim(hash, ' ')) AS hash, size, mtime, doc_type, title FROM manifest),
nos AS (SELECT snapshot_no, max(delivery_no) AS delivery_no, row_number() OVER (ORDER BY snapshot_no DESC) - 1 AS back FROM m GROUP BY 1),
states AS (SELECT * FROM (
  SELECT back, m.*, row_number() OVER (PARTITION BY back, path ORDER BY mtime DESC NULLS LAST, hash DESC NULLS LAST, size DESC NULLS LAST,
    doc_type DESC NULLS LAST, title DESC NULLS LAST) AS rn FROM m JOIN nos USING (snapshot_no, delivery_no) WHERE back < 2) WHERE rn = 1)"""
LOG = f"""{STATES}, o AS (SELECT * FROM states WHERE back = 1), n AS (SELECT * FROM states WHERE back = 0),
kept AS (SELECT o.path, o.path AS old_path, CASE WHEN o.hash IS NULL OR n.hash IS NULL OR o.hash <> n.hash THEN 'updated'
  WHEN o.doc_type IS NOT DISTINCT FROM n.doc_type AND o.title IS NOT DISTINCT FROM n.title THEN 'unchanged' ELSE 'retyped' END AS action FROM o JOIN n USING (path)),
gone AS (SELECT path, hash, CASE WHEN hash IS NOT NULL THEN row_number() OVER (PARTITION BY hash ORDER BY path) END AS turn FROM o WHERE path NOT IN (SELECT path FROM n)),
fresh AS (SELECT path, hash, CASE WHEN hash IS NOT NULL THEN row_number() OVER (PARTITION BY hash ORDER BY path) END AS turn FROM n WHERE path NOT IN (SELECT path FROM o)),
paired AS (SELECT coalesce(f.path, g.path) AS path, g.path AS old_path, CASE WHEN f.path IS NULL THEN 'removed' WHEN g.path IS NULL THEN 'added' ELSE 'moved' END AS action
  FROM gone g FULL JOIN fresh f ON g.hash = f.hash AND g.turn = f.turn),
log AS (SELECT * FROM kept UNION ALL SELECT * FROM paired)"""

MOVED = r"""WITH m AS (
  SELECT snapshot_no, delivery_no, regexp_replace(replace(path, '\', '/'), '^\./', '') AS path, lower(trim(hash, ' ')) AS hash, size, mtime, doc_type, title FROM manifest),
nos AS (SELECT snapshot_no, delivery_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next FROM (SELECT snapshot_no, max(delivery_no) AS delivery_no FROM m GROUP BY 1)),
one AS (SELECT * FROM (SELECT m.*, next, row_number() OVER (PARTITION BY m.snapshot_no, path ORDER BY mtime DESC NULLS LAST, hash DESC NULLS LAST,
  size DESC NULLS LAST, doc_type DESC NULLS LAST, title DESC NULLS LAST) AS rn FROM m JOIN nos USING (snapshot_no, delivery_no)) WHERE rn = 1),
gone AS (SELECT next AS snapshot_no, path, hash, row_number() OVER (PARTITION BY next, hash ORDER BY path) AS turn FROM one o
  WHERE next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM one n WHERE n.snapshot_no = o.next AND n.path = o.path)),
fresh AS (SELECT snapshot_no, path, hash, row_number() OVER (PARTITION BY snapshot_no, hash ORDER BY path) AS turn FROM one n
  WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.next = n.snapshot_no AND o.path = n.path))
SELECT snapshot_no, f.path, g.path AS old_path FROM gone g JOIN fresh f USING (snapshot_no, hash, turn)"""

RENAMED = f"""{STATES}, o AS (SELECT * FROM states WHERE back = 0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, hash DESC NULLS LAST, size DESC NULLS LAST, doc_type DESC NULLS LAST, title DESC NULLS LAST) AS again
  FROM (SELECT replace(path, '/drafts/', '/chapters/') AS path, hash, size, mtime, doc_type, title FROM o)) WHERE again = 1),
gone AS (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY path) AS turn FROM o WHERE path NOT IN (SELECT path FROM n)),
fresh AS (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY path) AS turn FROM n WHERE path NOT IN (SELECT path FROM o))
SELECT f.path, g.path AS old_path FROM gone g JOIN fresh f USING (hash, turn)"""

#: Each conversation's messages, as the query makes them of passages.
MESSAGES = """said AS (SELECT concat_ws('#', path, doc_id) AS conv_id, row_id AS turn, CASE WHEN row_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, max(text) AS text
  FROM passages WHERE text IS NOT NULL GROUP BY row_id, path, doc_id)"""
_WORDS = f"""list_transform(regexp_extract_all(lower({fold('text')}), '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)*'),
    lambda x: replace(regexp_replace(x, '''s$', ''), '''', ''))"""
_POINTING = ", ".join(map(quoted, PRONOUNS))
_EMPTY = ", ".join(map(quoted, sorted({*T.COMMON_WORDS, *PRONOUNS})))
_SPACES = r"\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Files' passages one after the other, and whether each still fits their prompt.
_COST, _MOST = f"n.chars + {Prompt().per_passage}", Prompt().budget
TAKEN = f"""r AS (SELECT row_id, path, max(length(text)) AS chars FROM passages GROUP BY ALL HAVING max(length(text)) IS NOT NULL),
n AS (SELECT row_id, path, chars, row_number() OVER (PARTITION BY path ORDER BY row_id) AS i, count(*) OVER (PARTITION BY path) AS last FROM r),
f AS (SELECT row_id, path, i, last, true AS taken, 1::BIGINT AS used, ({_COST})::BIGINT AS total FROM n WHERE i = 1
  UNION ALL SELECT n.row_id, f.path, n.i, f.last, total + {_COST} <= {_MOST}, f.used + (total + {_COST} <= {_MOST})::INT, total + CASE WHEN total + {_COST} <= {_MOST} THEN {_COST} ELSE 0 END
  FROM f JOIN n ON n.path = f.path AND n.i = f.i + 1)"""

_NAME = "regexp_extract(path, '[^/]*$')"
_STEM = f"CASE WHEN regexp_matches({_NAME}, '^.+\\.[^.]+$') THEN regexp_replace({_NAME}, '\\.[^.]+$', '') ELSE {_NAME} END"
_SPACED = f"trim(regexp_replace(regexp_replace({_STEM}, '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"

SQL: dict[str, str] = {
    "p4_found": P4,
    "clean_text_len": r"""SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(replace(text, chr(65279), ''),
        '\r\n?', chr(10), 'g'), chr(8232), chr(10)), '[\x{2029}\f]', chr(10) || chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+\n', chr(10), 'g'),
        '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), chr(10)))::INT AS chars FROM documents""",
    "collapse_preview": r"""SELECT doc_id, CASE WHEN length(line) <= 80 THEN line ELSE rtrim(substr(line, 1, 79), ' ') || '…' END AS preview
        FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS line FROM documents)""",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "doc_type_from_path": f"""WITH kinds(folder, kind) AS (VALUES {_KINDS}), f AS (SELECT DISTINCT path FROM files),
        parts AS (SELECT path, unnest(string_split(path, '/')[:-2]) AS part, generate_subscripts(string_split(path, '/')[:-2], 1) AS pos FROM f),
        first AS (SELECT path, arg_min(kind, pos) AS kind FROM parts JOIN kinds ON folder = lower(part) GROUP BY 1)
        SELECT path, coalesce(kind, 'other') AS kind FROM f LEFT JOIN first USING (path)""",
    "citations": "SELECT DISTINCT row_id, path || coalesce(' (' || coalesce(nullif(section, ''), nullif(title, '')) || ')', '') AS citation FROM passages",
    "embed_headers": """SELECT DISTINCT row_id, length(CASE WHEN concat_ws(' - ', nullif(title, ''), nullif(section, '')) = '' THEN coalesce(text, '')
        ELSE concat_ws(' - ', nullif(title, ''), nullif(section, '')) || chr(10) || chr(10) || coalesce(text, '') END)::INT AS chars FROM passages""",
    "token_counts": f"WITH {CORPUS} SELECT row_id, len(tokens)::INT AS dl FROM words",
    "corpus_stats": f"WITH {CORPUS}, {STATS} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM stats",
    "doc_frequency": f"WITH {POSTED} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posted GROUP BY 1",
    "postings_top_terms": f"WITH {POSTED} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posted GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "rare_terms": f"WITH {POSTED} SELECT term, count(*) AS df FROM posted GROUP BY 1 HAVING count(*) <= greatest(3, floor((SELECT count(*) FROM documents) * 0.01))",
    "bm25_scores": f"WITH {BM25} SELECT row_id, round(literal, 6) AS literal FROM bm",
    "bm25_from_postings": f"WITH {BM25} SELECT row_id, round(literal, 6) AS literal FROM bm",
    "bm25_topk": f"WITH {BM25} SELECT row_id, round(literal, 6) AS literal FROM bm ORDER BY 2 DESC, 1 LIMIT 20",
    "presence_fraction": f"""WITH {CORPUS} SELECT row_id, round(len(list_intersect(tokens, [{_NAMES}])) / {len(Q.NAMES)}.0, 6) AS held
        FROM words WHERE len(list_intersect(tokens, [{_NAMES}])) > 0""",
    "cosine_topk": """SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS cos
        FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20""",
    "minmax_normalised": """WITH s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings)
        SELECT vec_id, round((c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), 6) AS scaled FROM s""",
    "hybrid_topk": ranked(FIXED_NAMES, Q.PLAN.bonuses, Q.PHRASE, True),
    "hybrid_type_filtered": ranked(FIXED_NAMES, Q.PLAN.bonuses, Q.PHRASE, True, ("history", "culture")),
    "search_indexed": ranked(FIXED_NAMES, Q.PLAN.bonuses, Q.PHRASE, True),
    "search_stored": ranked(FIXED_NAMES, Q.PLAN.bonuses, Q.PHRASE, False),
    "planned_search": ranked(ASKED_NAMES, {"other": -0.01, "location": 0.07}, Q.PHRASE, False, terms=ASKED_TERMS, shown=True),
    "literal_only_topk": ranked(None, {}, None, False),
    "phrase_boost_topk": ranked(None, {}, Q.PHRASE, False),
    "intent_nudge_topk": ranked(None, Q.PLAN.bonuses, None, False),
    "file_cap_topk": ranked(None, {}, None, False, k=40, cap=1),
    "find_literal": f"WITH {places(Q.NEEDLE)} SELECT * FROM found",
    "find_files": f"WITH {places(Q.NEEDLE)} SELECT path, count(*) AS matches FROM found GROUP BY 1",
    "find_typed": f"WITH {places('the', "doc_type IN ('history', 'plot')")} SELECT row_id, count(*) AS places FROM found GROUP BY 1",
    "change_log": f"WITH {LOG} SELECT path, old_path, action FROM log",
    "moved_files": MOVED,
    "moved_folder": f"WITH {RENAMED}",
    "stale_counts": f"""WITH {STATES}, o AS (SELECT * FROM states WHERE back = 1),
        f AS (SELECT path, size, mtime FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, hash DESC NULLS LAST, size DESC NULLS LAST) AS rn FROM files) WHERE rn = 1)
        SELECT count(*) FILTER (o.path IS NULL) AS added, count(*) FILTER (f.path IS NULL) AS missing,
          count(*) FILTER (o.path IS NOT NULL AND f.path IS NOT NULL AND (o.size IS DISTINCT FROM f.size OR coalesce(f.mtime > o.mtime + 1.0, false))) AS changed
        FROM o FULL JOIN f ON o.path = f.path""",
    "status_by_type": "SELECT coalesce(doc_type, 'other') AS doc_type, count(DISTINCT row_id) AS passages, count(DISTINCT path) AS files FROM passages GROUP BY 1",
    "chunk_counts": "SELECT path, count(DISTINCT row_id) AS chunks FROM passages GROUP BY 1",
    "orphan_passages": "SELECT DISTINCT row_id, path FROM passages p WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.path = p.path)",
    "pretty_titles": f"""WITH s AS (SELECT DISTINCT path, {_NAME} AS name, {_SPACED} AS spaced FROM files)
        SELECT path, CASE WHEN spaced = '' THEN name WHEN spaced = lower(spaced) AND regexp_matches(spaced, '\\p{{L}}')
          THEN array_to_string(list_transform(string_split(spaced, ' '), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ') ELSE spaced END AS pretty FROM s""",
    "prompt_budget": f"WITH RECURSIVE {TAKEN} SELECT path, used, total AS context_chars FROM f WHERE i = last",
    "prompt_blocks": f"""WITH RECURSIVE {TAKEN}, t AS (SELECT row_id, path, max(doc_type) AS doc_type, max(section) AS section, max(title) AS title, max(text) AS text FROM passages WHERE text IS NOT NULL GROUP BY ALL)
        SELECT row_id, path, used::INT AS prompt_n, sha256('[' || used || '] ' || coalesce(doc_type, 'other') || ' - ' || path || coalesce(' (' || coalesce(nullif(section, ''), nullif(title, '')) || ')', '')
          || chr(10) || regexp_replace(text, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')) AS block FROM f JOIN t USING (row_id, path) WHERE taken""",
    "chunk_passages": chunk_sql(),
    "stream_passages": chunk_sql(),
    "chunk_spans_valid": r"SELECT DISTINCT coalesce(path, '') AS path, sha256(text) AS doc, 0::BIGINT AS wrong FROM docs WHERE length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 3",
    "embedded_texts": f"SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[^{_SPACES}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents",
    "unit_vectors": """SELECT DISTINCT row_id, CASE WHEN len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM vectors
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0""",
    "found_snippets": f"""WITH {places(Q.NEEDLE)}, t AS (SELECT row_id, max(text) AS text FROM passages GROUP BY 1),
        w AS (SELECT row_id, local, text, local + {len(Q.NEEDLE)} AS until, substr(text, greatest(local - 60, 0) + 1, least(local, 60)) AS before,
          substr(text, local + {len(Q.NEEDLE)} + 1, 60) AS after FROM found JOIN t USING (row_id))
        SELECT row_id, local, CASE WHEN local > 60 THEN regexp_replace(before, '^[^ ]* ', '') ELSE before END || '>>' || substr(text, local + 1, {len(Q.NEEDLE)}) || '<<'
          || CASE WHEN length(text) > until + 60 THEN regexp_replace(after, ' [^ ]*$', '') ELSE after END AS shown FROM w""",
    "chat_history_window": f"""WITH {MESSAGES} SELECT conv_id, turn, role, sha256(CASE WHEN role = 'user' THEN text
          WHEN length(trim(text, ' ')) > {KEPT_CHARS} THEN rtrim(substr(trim(text, ' '), 1, {KEPT_CHARS}), ' ') || ' ...' ELSE trim(text, ' ') END) AS said
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM said) WHERE back <= {KEPT_MESSAGES}""",
    "followup_search_text": f"""WITH {MESSAGES}, u AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, {_WORDS} AS words FROM said WHERE role = 'user')
        SELECT conv_id, turn, sha256(CASE WHEN before IS NOT NULL AND len(list_intersect(words, [{_POINTING}])) > 0
          AND (len(words) <= 8 OR len(list_filter(words, lambda x: NOT list_contains([{_EMPTY}], x))) = 0) THEN before || ' ' || text ELSE text END) AS asked FROM u""",
}
