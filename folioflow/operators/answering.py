"""What is given to a generator: prompt budget and text, and the turns of a conversation."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folioflow.config import Prompt
from folioflow.functions.text import COMMON_WORDS, tokens

KEPT_MESSAGES = 8
KEPT_CHARS = 700
#: Words that point back to what was said.
PRONOUNS = ("he", "him", "his", "she", "her", "hers", "they", "them", "their", "it", "its", "that", "this", "those", "these", "there")


class Generator(Protocol):
    """Whatever answers a prompt, piece by piece; it runs on the driver."""

    def stream(self, messages: list[dict[str, str]]) -> Iterator[str]: ...


def prompt_passages(hits: DataFrame, by: str, order: list[str], size: Column, p: Prompt = Prompt()) -> DataFrame:
    """``by``, the columns of ``order``, ``size, prompt_n``: the hits of each group that fit the budget, numbered as they are used.

    In the given order, the first hit always; a hit that doesn't fit is left out and later, smaller
    ones may still be taken. That depends on what was taken before, so the rows of a group are sorted in
    one partition and only its two sums go from row to row, whatever its length. A null size counts as 0.
    """
    rows = hits.select(by, *order, F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    placed = rows.repartition(by).sortWithinPartitions(by, *order, "size")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used, total = None, 0, 0
        for batch in batches:
            taken, numbers = [], []
            for i, (key, n) in enumerate(zip(batch[by].to_pylist(), batch["size"].to_pylist())):
                if used and key != group:
                    used, total = 0, 0
                group = key
                if not used or total + n + p.per_passage <= p.budget:
                    used, total = used + 1, total + n + p.per_passage
                    taken.append(i)
                    numbers.append(used)
            kept = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(numbers, pa.int32())], names=[*batch.schema.names, "prompt_n"])

    return placed.mapInArrow(fold, StructType([*placed.schema.fields, StructField("prompt_n", IntegerType())]))


def prompt_budget(hits: DataFrame, by: str, order: list[str], size: Column, p: Prompt = Prompt()) -> DataFrame:
    """``by, used, context_chars``: how many hits of each group fit the budget (see ``prompt_passages``), and what they take of it."""
    taken = prompt_passages(hits, by, order, size, p)
    return taken.groupBy(by).agg(F.count(F.lit(1)).alias("used"), F.sum(F.col("size") + p.per_passage).alias("context_chars"))


def prompt_block(n: Column, doc_type: Column, path: Column, section: Column, title: Column, text: Column) -> Column:
    """A passage as it stands in a prompt: its number, kind, file and place on one line, its text below."""
    none = F.lit("")
    where = F.coalesce(F.nullif(section, none), F.nullif(title, none))
    head = F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.coalesce(doc_type, F.lit("other")), F.lit(" - "), path)
    return F.concat(head, F.coalesce(F.concat(F.lit(" ("), where, F.lit(")")), none), F.lit("\n"), F.regexp_replace(text, r"^\s+|\s+$", ""))


def build_messages(question: str, hits: list[dict], history: list[dict[str, str]] = (), system: str = "", p: Prompt = Prompt()) -> list[dict[str, str]]:
    """The messages for a generator from collected hits (best first), numbered as they are used."""
    blocks, total = [], 0
    for hit in hits:
        cost = len(hit["text"]) + p.per_passage
        if blocks and total + cost > p.budget:
            continue
        total += cost
        where = hit.get("section") or hit.get("title") or ""
        blocks.append(f"[{len(blocks) + 1}] {hit.get('doc_type', 'other')} - {hit['path']}{f' ({where})' if where else ''}\n{hit['text'].strip()}")
    given = "\n\n".join(blocks) if blocks else "No passages were found."
    first = [{"role": "system", "content": system}] if system else []
    return [*first, *history, {"role": "user", "content": f"Passages:\n\n{given}\n\nQuestion: {question}"}]


def history_window(messages: DataFrame, keep: int = KEPT_MESSAGES, chars: int = KEPT_CHARS) -> DataFrame:
    """The last messages of each conversation (conv_id, turn, role, text), answers of more than ``chars`` shortened.

    Each task keeps its own last messages before the shuffle, so no conversation is brought together whole.
    """
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    said = F.trim("text")
    told = F.when(F.length(said) > chars, F.concat(F.rtrim(F.substring(said, 1, chars)), F.lit(" ..."))).otherwise(said)
    short = F.when(F.col("role") == "assistant", told).otherwise(F.col("text"))
    return messages.withColumn("back", turn).where(F.col("back") <= keep).withColumn("text", short).drop("back")


def followup_text(messages: DataFrame) -> DataFrame:
    """The users' messages with ``search_text``: the one before put in front where a short one points back."""
    users = messages.where("role = 'user'").withColumn("words", tokens(F.col("text")))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    points = F.arrays_overlap("words", F.array(*[F.lit(x) for x in PRONOUNS]))
    subject = F.size(F.filter("words", lambda w: ~w.isin(*sorted(COMMON_WORDS), *PRONOUNS))) > 0
    uses = points & before.isNotNull() & ((F.size("words") <= 8) | ~subject)
    return users.withColumn("before", before).withColumn("search_text", F.when(uses, F.concat_ws(" ", before, "text")).otherwise(F.col("text"))).drop("words", "before")
