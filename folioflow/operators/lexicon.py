"""Inverted index, corpus statistics and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import match_text, tokens
from folioflow.plans.runtime import cut, spread

K1, B = 1.5, 0.75


def with_tokens(passages: DataFrame) -> DataFrame:
    """``passages`` with ``tokens`` of title, section and text, and their number ``dl``."""
    words = tokens(match_text(F.col("title"), F.col("section"), F.col("text")))
    return passages.withColumn("tokens", words).withColumn("dl", F.size("tokens"))


def postings(tokenised: DataFrame) -> DataFrame:
    """``term, row_id, tf, dl``: counted in the scan's stage before the one shuffle by (term, row)."""
    return tokenised.select("row_id", "dl", F.explode("tokens").alias("term")).groupBy("term", "row_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(tokenised: DataFrame) -> DataFrame:
    """``term, df, cf``: rows that hold a term, and how often it stands in all of them.

    A row gives each different word once for ``df`` and all words for ``cf``; both are summed by term
    before the shuffle, which so holds a task's vocabulary and not one record for each row and word.
    """
    once = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf")))
    every = F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf")))
    counted = tokenised.select(F.explode(F.concat(once, every)).alias("w")).select("w.*")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def corpus_stats(tokenised: DataFrame) -> DataFrame:
    """One row: ``n_docs, avgdl`` (at least 1)."""
    return tokenised.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def rare_terms(stats: DataFrame, n_docs: Column) -> DataFrame:
    """Terms rare enough to be taken for names: in at most 3 rows, or 1 % of all."""
    return stats.where(F.col("df") <= F.greatest(F.lit(3), F.floor(n_docs * 0.01)))


def _weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def counted_terms(passages: DataFrame, terms: list[str]) -> DataFrame:
    """``passages`` without their texts, with ``dl`` and ``tf array<int>`` (one place a term), written once.

    The only pass over the texts that ranking needs: statistics, scores and their bounds are all made
    from these narrow rows.
    """
    t = with_tokens(spread(passages.drop("embedding")))
    # Without the term an array is shorter by its occurrences; no function runs for each word.
    tf = [F.size("tokens") - F.size(F.array_remove("tokens", x)) for x in terms]
    kept = [c for c in passages.columns if c not in ("text", "embedding")]
    return cut(t.select(*kept, "dl", F.array(*tf).cast("array<int>").alias("tf")))


def query_stats(counted: DataFrame, terms: list[str]) -> DataFrame:
    """One row of what BM25 needs of the whole corpus: its size, mean length, and each term's frequency."""
    present = [F.coalesce(F.sum((F.col("tf")[i] > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(len(terms))]
    return counted.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"), *present)


def stats_of(counted: DataFrame, terms: list[str]) -> dict[str, Column]:
    """``query_stats`` as constants: one row, read to the driver."""
    return {k: F.lit(v) for k, v in query_stats(counted, terms).first().asDict().items()}


def bm25_column(terms: list[str], asked: list[str]) -> Column:
    """The BM25 score by ``asked`` terms of a row of ``counted_terms`` that carries ``query_stats``."""
    total = F.lit(0.0)
    for i, t in enumerate(terms):
        if t in asked:
            total = total + _weight(F.col("tf")[i], F.col("dl"), F.col(f"df{i}"), F.col("n_docs"), F.col("avgdl"))
    return total


def bm25_scan(passages: DataFrame, terms: list[str]) -> DataFrame:
    """``passages`` without their texts, with ``literal``: without an index, by one pass over the texts."""
    terms = list(dict.fromkeys(terms))
    counted = counted_terms(passages, terms)
    scored = counted.withColumns(stats_of(counted, terms)).withColumn("literal", bm25_column(terms, terms))
    return scored.select(*[c for c in counted.columns if c not in ("dl", "tf")], "literal")


def bm25_indexed(posted: DataFrame, stats: DataFrame, terms: list[str], names: list[str] = ()) -> DataFrame:
    """``row_id, literal, held`` from stored postings: the terms are a filter that reaches the scan.

    ``literal`` is the score by ``terms``, ``held`` the share of ``names`` that the row has.
    """
    terms, names = list(dict.fromkeys(terms)), list(dict.fromkeys(names))
    # Needed twice, and no more than the postings of the query's words.
    hits = cut(posted.where(F.col("term").isin([*terms, *names])))
    # One row per word of the query.
    frequency = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = hits.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(stats))
    weight = F.when(F.col("term").isin(terms), _weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avgdl"))).otherwise(0.0)
    held = F.sum(F.col("term").isin(names).cast("int")) / F.lit(float(max(1, len(names))))
    return weighted.groupBy("row_id").agg(F.sum(weight).alias("literal"), held.alias("held"))


def presence(terms: list[str], names: list[str]) -> Column:
    """The share of the different ``names``, all among ``terms``, that a row of ``counted_terms`` holds."""
    names = list(dict.fromkeys(names))
    held = F.lit(0)
    for n in names:
        held = held + (F.col("tf")[terms.index(n)] > 0).cast("int")
    return held / F.lit(float(max(1, len(names))))
