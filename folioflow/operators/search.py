"""Hybrid ranked search: cosine and BM25 blended, with boosts and a cap per file."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import Retrieval
from folioflow.functions.text import COMMON_WORDS, match_form, match_query, match_text, query_terms, quoted_phrases
from folioflow.operators.lexicon import bm25_column, bm25_indexed, counted_terms, presence, query_stats, stats_of
from folioflow.plans.runtime import cut


@dataclass(frozen=True)
class QueryPlan:
    """What a query asks for, worked out on the driver from the query string and the frequencies of its words."""

    terms: list[str]
    names: list[str] = field(default_factory=list)
    bonuses: dict[str, float] = field(default_factory=dict)
    phrases: list[str] = field(default_factory=list)
    vector: list[float] | None = None

    @property
    def words(self) -> list[str]:
        """Terms and names, each once."""
        return list(dict.fromkeys([*self.terms, *self.names]))


def intent_bonuses(query: str, r: Retrieval) -> dict[str, float]:
    """One bonus for each kind of material that the query's wording hints at, over the standing ones."""
    words = {t for t, _ in query_terms(query)}
    padded = f" {match_query(query)} "
    out = dict(r.doc_type_bonus)
    for kind, cues in r.intent_cues.items():
        if any(cue in (padded if " " in cue else words) for cue in map(str.lower, cues)):
            out[kind] = out.get(kind, 0.0) + r.intent_bonus
    return out


def name_terms(query: str, n: int, df: dict[str, int]) -> list[str]:
    """Words of the query to be taken for names: in the corpus of ``n`` rows, not common, and capitalised or rare."""
    rare = max(3, int(n * 0.01))
    pairs = [(t, raw, i) for i, (t, raw) in enumerate(query_terms(query)) if t not in COMMON_WORDS]
    return list(dict.fromkeys(t for t, raw, i in pairs if df.get(t, 0) > 0 and ((raw[0].isupper() and i > 0) or df[t] <= rare)))


def asked_terms(query: str) -> list[str]:
    """The different terms of a query; an error for a blank one."""
    if not query.strip():
        raise ValueError("the query is empty")
    return list(dict.fromkeys(t for t, _ in query_terms(query)))


def plan_query(query: str, n: int, df: dict[str, int], r: Retrieval = Retrieval(), vector: list[float] | None = None) -> QueryPlan:
    """The plan for a query, given how many passages there are and how many hold each of its terms."""
    terms, query = asked_terms(query), query.strip()
    phrases = quoted_phrases(query)
    if not phrases and len(terms) <= 5 and len(query) >= 4:
        phrases = [match_query(query)]
    elif r.fold_quoted_phrases:
        phrases = [p.lower() for p in phrases]
    return QueryPlan(terms, name_terms(query, n, df), intent_bonuses(query, r), phrases, vector)


def cosine(embedding: Column, vector: list[float]) -> Column:
    """Dot product in double precision with a unit vector; null for a null embedding, an error for one of another length."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    products = F.zip_with(embedding, q, lambda a, b: a.cast("double") * b)
    wrong = F.concat(F.lit("the index has vectors of "), F.size(embedding).cast("string"), F.lit(f" numbers, the query one of {len(vector)}; build the index again"))
    return F.when(F.size(embedding) != len(vector), F.raise_error(wrong).cast("double")).otherwise(F.aggregate(products, F.lit(0.0), lambda total, x: total + x))


def normalised(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0 .. 1; 0 where all values are the same."""
    return F.when(high - low < 1e-9, 0.0).otherwise((value - low) / (high - low))


def blended(rows: DataFrame, plan: QueryPlan, r: Retrieval = Retrieval()) -> DataFrame:
    """Narrow rows of all passages (``doc_type, semantic, literal, held`` and keys) with their ``score`` before phrases.

    The bounds for scaling cover all rows, whatever is filtered later.
    """
    # One row.
    s0, s1, l0, l1 = (F.lit(x or 0.0) for x in rows.agg(F.min("semantic"), F.max("semantic"), F.min("literal"), F.max("literal")).first())
    ws, wl = r.weights() if plan.vector else (0.0, 1.0)
    blend = normalised(F.col("literal"), l0, l1) * wl
    if plan.vector:
        blend = normalised(F.col("semantic"), s0, s1) * ws + blend
    bonus = F.lit(0.0)
    for kind, extra in plan.bonuses.items():
        bonus = bonus + F.when(F.col("doc_type") == kind, extra).otherwise(0.0)
    boosted = rows.withColumns({"name_boost": F.col("held") * r.proper_noun_boost, "type_bonus": bonus})
    return boosted.withColumn("score", blend + F.col("name_boost") + F.col("type_bonus"))


def cap_per_file(hits: DataFrame, k: int, most: int) -> DataFrame:
    """The best ``k``, of each path first at most ``most``; the others only fill what is left (``tier`` 1)."""
    turn = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "row_id"))
    return hits.withColumn("tier", (turn > most).cast("int")).orderBy("tier", F.desc("score"), "row_id").limit(k)


def _ranked(rows: DataFrame, passages: DataFrame, plan: QueryPlan, r: Retrieval, k: int | None, doc_types: list[str] | None) -> DataFrame:
    """Blend, filter, shortlist, phrase boost, cap and order; the shortlist alone meets its texts again."""
    k = k or r.k
    if k < 1:
        raise ValueError("k must be at least 1")
    scored = blended(rows, plan, r)
    if doc_types:
        scored = scored.where(F.col("doc_type").isin(doc_types))
    short = scored.orderBy(F.desc("score"), "row_id").limit(r.candidates)
    names = list(dict.fromkeys(plan.names))
    hit, held = F.lit(False), F.array().cast("array<string>")
    if plan.phrases or names:
        # No more rows than the shortlist on one side; their forms are made after the join.
        texts = passages.select("row_id", "title", "section", "text")
        short = texts.join(F.broadcast(short), "row_id")
        short = short.withColumn("form", match_form(match_text(F.col("title"), F.col("section"), F.col("text")))).drop("title", "section", "text")
        for p in plan.phrases:
            hit = hit | F.col("form").contains(p)
        if names:
            held = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.col("form"), n))
    short = short.withColumns({"phrase_hit": hit, "names_matched": held}).drop("form")
    short = short.withColumn("score", F.col("score") + F.col("phrase_hit").cast("int") * r.phrase_boost)
    return cap_per_file(short, k, r.max_per_file)


def _rows(passages: DataFrame, scores: DataFrame, plan: QueryPlan, vectors: DataFrame | None) -> DataFrame:
    """Scores with ``semantic``, of the vectors given beside or held by the passages; both sides of the join are narrow."""
    if not plan.vector:
        return scores.withColumn("semantic", F.lit(0.0))
    source = vectors if vectors is not None else passages
    near = source.select("row_id", cosine(F.col("embedding"), plan.vector).alias("semantic"))
    return scores.join(near, "row_id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))


def search(
    passages: DataFrame,
    plan: QueryPlan,
    r: Retrieval = Retrieval(),
    k: int | None = None,
    doc_types: list[str] | None = None,
    vectors: DataFrame | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """The best ``k`` passages for a plan, without an index: one pass over the texts, then narrow rows only.

    ``passages``: row_id (unique), path, doc_type, title, section, text and, for a plan with a vector, embedding
    (unit length or null) unless ``vectors`` (row_id, embedding) are given. ``counted``: their
    ``counted_terms`` of the plan's words, where they are there already. Ties go to the smaller row_id.
    Returns row_id, path, doc_type, semantic, literal, name_boost, type_bonus, score, phrase_hit,
    names_matched, tier.
    """
    keys = passages.select("row_id", "path", "doc_type", "title", "section", "text")
    words = plan.words
    if counted is None:
        counted = counted_terms(keys, words)
    scores = counted.withColumns(stats_of(counted, words)).select("row_id", "path", "doc_type", bm25_column(words, plan.terms).alias("literal"), presence(words, plan.names).alias("held"))
    return _ranked(_rows(passages, scores, plan, vectors), passages, plan, r, k, doc_types)


def ask(passages: DataFrame, query: str, r: Retrieval = Retrieval(), k: int | None = None, doc_types: list[str] | None = None, vector: list[float] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """``search`` for a question in words: names, intent and phrases are worked out from it and the counts of its terms."""
    terms = asked_terms(query)
    counted = counted_terms(passages.select("row_id", "path", "doc_type", "title", "section", "text"), terms)
    n, _, *df = query_stats(counted, terms).first()
    return search(passages, plan_query(query, n, dict(zip(terms, df)), r, vector), r, k, doc_types, vectors, counted)


def search_indexed(
    passages: DataFrame,
    posted: DataFrame,
    stats: DataFrame,
    plan: QueryPlan,
    r: Retrieval = Retrieval(),
    k: int | None = None,
    doc_types: list[str] | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """``search`` by stored postings and statistics: no text is read but those of the shortlist.

    The query's words are a filter on the postings; their scores, of only the rows that hold one, are
    joined to the keys and cosines of all passages.
    """
    hits = bm25_indexed(posted, stats, plan.terms, plan.names)
    zero = {x: F.coalesce(x, F.lit(0.0)) for x in ("literal", "held")}
    scores = passages.select("row_id", "path", "doc_type").join(hits, "row_id", "left").withColumns(zero)
    # Written once, as the bounds need them before the blend does.
    return _ranked(cut(_rows(passages, scores, plan, vectors)), passages, plan, r, k, doc_types)


def ask_indexed(passages: DataFrame, posted: DataFrame, stats: DataFrame, query: str, r: Retrieval = Retrieval(), k: int | None = None, doc_types: list[str] | None = None, vector: list[float] | None = None) -> DataFrame:
    """``search_indexed`` for a question in words."""
    counts = posted.where(F.col("term").isin(asked_terms(query))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # One row per word of the query.
    plan = plan_query(query, stats.first()["n_docs"], {x.term: x.df for x in counts.collect()}, r, vector)
    return search_indexed(passages, posted, stats, plan, r, k, doc_types)
