"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.leakage import leaked_items
from folioflow.llm.lookalikes import look_alike_keys, look_alike_pairs
from folioflow.llm.neardup import NearDuplicates, duplicate_groups, duplicate_pairs, near_duplicates
from folioflow.llm.neighbours import nearest_vectors, neighbour_pairs
from folioflow.llm.splitting import cut_kinds, split_oversized
from folioflow.llm.subjects import document_subjects
from folioflow.llm.tokens import encode_corpus
from folioflow.plans.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_pairs(nearest_vectors(table(spark, sf, "vectors")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return look_alike_pairs(look_alike_keys(table(spark, sf, "passages")))


def p2_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent form of every text and section that isn't in it already."""
    return look_alike_keys(table(spark, sf, "passages")).where("form is not null and raw <> key").select("field", "row_id", "form").distinct()


def _split(spark: SparkSession, sf: str, with_text: bool) -> dict[str, DataFrame]:
    return {
        "docs": split_oversized(table(spark, sf, "docs"), "load_id", prefix="section_prefix", with_text=with_text, once=with_text),
        "passages": split_oversized(table(spark, sf, "passages"), "row_id", section="section", with_text=with_text, once=with_text),
    }


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (cut_kinds(p).select(F.lit(name).alias("item_table"), "item_id", "cut_kind") for name, p in _split(spark, sf, False).items())
    return a.unionByName(b)


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All pieces, with their text; rows delivered again give theirs once."""
    a, b = (p.select(F.lit(name).alias("item_table"), "*") for name, p in _split(spark, sf, True).items())
    return a.unionByName(b)


#: As TESTDATA.md states the problem: sets of three-word sequences, similarity 0.7, 20 words.
REVISED_PASSAGES = NearDuplicates(words=3, threshold=0.7, least_words=20)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_pairs(*near_duplicates(table(spark, sf, "passages"), REVISED_PASSAGES))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_groups(*near_duplicates(table(spark, sf, "passages"), REVISED_PASSAGES))


def p5_multiset_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links by multiset overlap of five-word sequences, 0.8 or more, between class representatives."""
    links, _ = near_duplicates(table(spark, sf, "passages"), NearDuplicates(multiset=True))
    return links.select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"), F.round("similarity", 6).alias("similarity"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items")).where("edits = 0").select("doc_id", "item_id")


def p7_revised(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks up to one character edit a window, with that number."""
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    return document_subjects(*(table(spark, sf, name) for name in ("documents", "subjects", "subject_labels")))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents and characters of the corpus each subject has, by kind of document."""
    documents = table(spark, sf, "documents").select("doc_id", "doc_type", F.length("text").alias("chars"))
    return (
        _subjects(spark, sf).join(documents, "doc_id").groupBy("subject", "doc_type").agg(F.count(F.lit(1)).alias("docs"), F.sum("chars").alias("chars"))
    )


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p2_found": p2_found, "p2_forms": p2_forms, "p3_found": p3_found, "p3_pieces": p3_pieces, "p5_found": p5_found, "p5_groups": p5_groups, "p5_multiset_links": p5_multiset_links, "p6_ids": p6_ids, "p7_found": p7_found, "p7_revised": p7_revised, "p8_found": p8_found, "p8_composition": p8_composition}
