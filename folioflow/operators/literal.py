"""Exhaustive literal search with exact offsets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import FOLDS, offset_form, snippet


def _places(needle: str):
    def of(text: str) -> list[int]:
        out, at = [], text.find(needle)
        while at >= 0:
            out.append(at)
            at = text.find(needle, at + 1)
        return out

    @F.pandas_udf("array<int>")
    def places(forms: pd.Series) -> pd.Series:
        return forms.map(of)

    return places


def find_literal(passages: DataFrame, needle: str, doc_types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """``row_id, path, doc_id, local, position``: every place where a string stands, overlapping ones too.

    Case, quotes, dashes and blanks match alike; offsets count characters. ``local`` is the place in the
    passage, ``position`` that in the document (``start_pos`` added). A place that several overlapping
    passages hold is reported once, for the smallest row_id. Blank needles are an error; null texts
    hold nothing.

    Only rows that hold the string at all (tested in the scan's stage) are folded and go to Python, in Arrow batches,
    where the places are found one after the other in linear time.
    """
    folded = needle.translate({ord(a): b for a, b in FOLDS.items()}).lower()
    if not folded.strip():
        raise ValueError("nothing to look for")
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    rows = passages.where(F.col("doc_type").isin(doc_types)) if doc_types else passages
    # A pattern of what each character may stand for needs no fold of the texts that lack the string.
    variants = {c: [c, *(a for a, b in FOLDS.items() if b == c)] for c in set(folded)}
    pattern = "".join("[" + "".join(f"\\x{{{ord(v):x}}}" for v in variants[c]) + "]" for c in folded)
    rows = rows.where(F.lower("text").rlike(pattern)).withColumn("form", offset_form(F.col("text"))).where(F.col("form").contains(folded))
    places = _places(folded)(F.col("form"))
    found = rows.select("row_id", "path", "doc_id", F.col("start_pos").alias("base"), F.explode(places).alias("local"))
    found = found.withColumn("position", F.coalesce("base", F.lit(0)) + F.col("local"))
    first = Window.partitionBy("path", "doc_id", "position").orderBy("row_id", "local")
    out = found.withColumn("turn", F.row_number().over(first)).where("turn = 1").select("row_id", "path", "doc_id", "local", "position")
    return out if limit is None else out.orderBy("row_id", "local").limit(limit)


def find_files(matches: DataFrame) -> DataFrame:
    """The files of matches, with how many each has."""
    return matches.groupBy("path").agg(F.count(F.lit(1)).alias("matches"))


def with_snippets(matches: DataFrame, passages: DataFrame, length: int, context: int) -> DataFrame:
    """Matches with ``shown``: the match of ``length`` characters in its passage, and ``context`` characters on either side.

    Rows of matches only are joined with their texts; a row_id that is delivered again counts once.
    """
    texts = passages.join(matches.select("row_id").distinct(), "row_id", "left_semi").groupBy("row_id").agg(F.max("text").alias("text"))
    return matches.join(texts, "row_id").withColumn("shown", snippet(F.col("text"), F.col("local"), length, context)).drop("text")
