import math
import random

import pytest

from folioflow.config import Retrieval
from folioflow.functions.text import query_terms
from folioflow.operators.lexicon import bm25_indexed, corpus_stats, postings, term_stats, with_tokens
from folioflow.operators.literal import find_files, find_literal, with_snippets
from folioflow.operators.search import QueryPlan, ask, intent_bonuses, plan_query, search, search_indexed

SCHEMA = "row_id bigint, path string, doc_type string, title string, section string, text string, embedding array<float>, doc_id string, start_pos int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(i, text, path="p", kind="manuscript", vector=None, doc="", start=0):
    return (i, path, kind, "", "", text, vector, doc, start)


def sequential(rows, plan, r, k, types=None):
    """The ranking rules one after the other, in plain Python."""
    tokens = {x[0]: [t for t, _ in query_terms(x[5])] for x in rows}
    n = len(rows)
    avg = max(1.0, sum(map(len, tokens.values())) / n)
    df = {t: sum(t in w for w in tokens.values()) for t in plan.terms}

    def bm(w):
        return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in plan.terms)

    lit = {i: bm(w) for i, w in tokens.items()}
    sem = {x[0]: sum(a * b for a, b in zip(x[6], plan.vector)) if x[6] and plan.vector else 0.0 for x in rows}

    def scale(v):
        low, high = min(v.values()), max(v.values())
        return {i: 0.0 if high - low < 1e-9 else (x - low) / (high - low) for i, x in v.items()}

    ws, wl = r.weights() if plan.vector else (0, 1)
    sl, ss = scale(lit), scale(sem)
    score = {}
    for x in rows:
        names = sum(m in tokens[x[0]] for m in plan.names) / len(plan.names) if plan.names else 0
        score[x[0]] = ws * ss[x[0]] + wl * sl[x[0]] + r.proper_noun_boost * names + plan.bonuses.get(x[2], 0)
    left = sorted((x for x in rows if not types or x[2] in types), key=lambda x: (-score[x[0]], x[0]))[: r.candidates]
    for x in left:
        score[x[0]] += r.phrase_boost * any(p in x[5].lower() for p in plan.phrases)
    left.sort(key=lambda x: (-score[x[0]], x[0]))
    first, rest, seen = [], [], {}
    for x in left:
        seen[x[1]] = seen.get(x[1], 0) + 1
        (first if seen[x[1]] <= r.max_per_file else rest).append(x[0])
    return [(i, round(score[i], 6)) for i in (first + rest)[:k]]


def test_random_corpora_rank_as_the_rules_say(spark):
    rng = random.Random(9)
    words = "harbour lamp court storm the of cold door stair kestrel".split()
    for case in range(3):
        rows = [
            row(i, " ".join(rng.choices(words, k=rng.randrange(1, 25))), f"f{rng.randrange(4)}", rng.choice(["plot", "history"]), [rng.random(), rng.random()] if rng.random() < 0.8 else None)
            for i in range(60)
        ]
        plan = QueryPlan(["harbour", "storm"], ["kestrel"], {"plot": 0.07}, ["cold door"], [0.6, 0.8] if case else None)
        r = Retrieval(candidates=30, max_per_file=2)
        got = search(frame(spark, rows).repartition(case + 1), plan, r, 12, ["plot"] if case == 2 else None).collect()
        t = with_tokens(frame(spark, rows))
        indexed = search_indexed(frame(spark, rows), postings(t), corpus_stats(t), plan, r, 12, ["plot"] if case == 2 else None).collect()
        assert [(h.row_id, round(h.score, 9)) for h in indexed] == [(h.row_id, round(h.score, 9)) for h in got]
        rows = [(*x[:6], [float(__import__("numpy").float32(v)) for v in x[6]] if x[6] else None, *x[7:]) for x in rows]
        assert [i for i, _ in sequential(rows, plan, r, 12, ["plot"] if case == 2 else None)] == [h.row_id for h in got]


def test_indexed_scores_and_stats(spark):
    t = with_tokens(frame(spark, [row(1, "a b a"), row(2, "b"), row(3, "")]))
    assert {tuple(r) for r in term_stats(t).collect()} == {("a", 1, 2), ("b", 2, 2)}
    stats = corpus_stats(t)
    assert tuple(stats.first()) == (3, 4 / 3)
    scores = {r.row_id: r.literal for r in bm25_indexed(postings(t), stats, ["a", "a", "zzz"]).collect()}
    assert set(scores) == {1}


def test_plan_of_a_question(spark):
    rows = [row(i, "the harbour was cold and the door stood open by the stair") for i in range(400)] + [row(900, "Kestrel spoke of Kestrels")]
    plan = plan_query("What did Kestrel say at the Harbour?", 401, {"kestrel": 1, "harbour": 400, "say": 0})
    assert plan.names == ["kestrel", "harbour"] and plan.phrases == []
    assert plan_query("cold door", 401, {}).phrases == ["cold door"]
    assert plan_query('"of \'x" "a" "she said"', 401, {}).phrases == ["of 'x", "she said"]
    cues = Retrieval(intent_cues={"character": ("Who is", "eyes"), "location": ("where",)})
    assert intent_bonuses("Who is she, with green eyes?", cues) == {"other": -0.01, "character": 0.07}
    with pytest.raises(ValueError):
        plan_query("  ", 1, {})
    best = ask(frame(spark, rows), "What did Kestrel say at the Harbour?").first()
    assert (best.row_id, best.names_matched) == (900, ["kestrel"])


def test_composed_forms_match_on_both_sides(spark):
    rows = [row(1, "ﬁnal ﬂame ①②"), row(2, "a cold door"), row(3, "Cafe\u0301 Ｗｉｄｅ"), row(4, "ordinary")]
    df = frame(spark, rows)
    assert ask(df, "final flame 12").first().row_id == 1
    assert ask(df, "café wide").first().phrase_hit
    # Offsets have to hold, so a literal search folds only what keeps its length.
    assert find_literal(df, "final").count() == 0 and find_literal(df, "ﬁnal").first().local == 0


def test_vectors_of_another_length_are_an_error(spark):
    df = frame(spark, [row(1, "a", vector=[1.0, 0.0, 0.0])])
    with pytest.raises(Exception, match="build the index again"):
        search(df, QueryPlan(["a"], vector=[1.0, 0.0])).collect()


def test_snippets_end_between_words(spark):
    df = frame(spark, [row(1, "one two three four five six seven"), row(2, "fourfour"), row(3, "x" * 30 + "four" + "y" * 30)])
    shown = {(r.row_id, r.local): r.shown for r in with_snippets(find_literal(df, "four"), df, 4, 6).collect()}
    assert shown == {(1, 14): ">>four<< five", (2, 0): ">>four<<four", (2, 4): "four>>four<<", (3, 30): "xxxxxx>>four<<yyyyyy"}


def test_find_literal(spark):
    rows = [
        row(1, "The the the end", start=10), row(2, "the end", start=18), row(3, "“Oh” the", path="q"), row(4, None), row(5, ""),
        row(6, "the end", doc="other", start=18),
    ]
    df = frame(spark, rows)
    found = sorted((r.row_id, r.local, r.position) for r in find_literal(df, "THE").collect())
    assert found == [(1, 0, 10), (1, 4, 14), (1, 8, 18), (3, 5, 5), (6, 0, 18)]
    assert [r.local for r in find_literal(frame(spark, [row(1, "aaaa")]), "aa").collect()] == [0, 1, 2]
    assert {tuple(r) for r in find_files(find_literal(df, '"oh"')).collect()} == {("q", 1)}
    assert len(find_literal(df, "the", limit=2).collect()) == 2
    for wrong in ({"needle": " "}, {"needle": "x", "limit": 0}):
        with pytest.raises(ValueError):
            find_literal(df, **wrong)
