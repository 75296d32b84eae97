"""Cutting oversized items into pieces at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.plans.runtime import cut, spread

LIMIT = 1800
OVERLAP = 150
#: Levels of the separator hierarchy, coarse to fine.
LEVELS = ("section", "paragraph", "sentence", "word", "character")

_HEADING = re.compile(r"^(?:(#{1,6})[ \t]+(\S[^\n]*)|(\S[^\n]*)\n(=+|-{2,})[ \t]*)$", re.M)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|\r?\n")
_PAUSE = re.compile(r"[。\uff01？」』、，,;:|/]+")
_BLANKS = " \t\n\r"


def sections(text: str, prefix: str = "") -> list[tuple[int, int, str]]:
    """(start, end, heading path) of each section; together they cover the text.

    A heading with nothing under it goes with the section that follows.
    """
    found = []
    stack: list[tuple[int, str]] = []
    start, body, label = 0, 0, prefix
    for m in _HEADING.finditer(text):
        level, title = (len(m[1]), m[2].rstrip(" #\t\r")) if m[1] else (1 if m[4][0] == "=" else 2, m[3].strip())
        if text[body : m.start()].strip():
            found.append((start, m.start(), label))
            start = m.start()
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        body = m.end()
        label = " > ".join([*([prefix] if prefix else []), *(t for _, t in stack)])
    if start < len(text):
        found.append((start, len(text), label))
    return found


def _whole_character(text: str, at: int, least: int) -> int:
    """``at``, moved back so that no combining mark or joined emoji is cut off its base."""
    i = at
    while i > least and i < len(text) and (unicodedata.category(text[i])[0] == "M" or text[i] == "\u200d" or text[i - 1] == "\u200d"):
        i -= 1
    return i if i > least else at


def pieces(text: str, start: int, end: int, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, level of the cut that ends it) of each piece of ``text[start:end]``.

    Each piece is packed up to ``limit`` and ends at the last boundary of the coarsest level that it
    holds. The next one goes back up to ``overlap`` characters, to the start of a sentence or word,
    unless a word that fits a piece by itself would have to be cut for that. Within a run that is cut
    anyway it goes back the whole ``overlap``, less only where a character has to be kept whole.
    """
    paragraphs = [m.end() for m in _PARAGRAPH.finditer(text, start, end)]
    sentences = [m.end() for m in _SENTENCE.finditer(text, start, end)]

    def last(places: list[int], low: int, high: int) -> int:
        i = bisect_right(places, high) - 1
        return places[i] if i >= 0 and places[i] > low else -1

    def word_end(low: int, high: int) -> int:
        """The last place in (low, high] beside a blank."""
        if high < end and text[high] in _BLANKS:
            return high
        return max([-1, *(p + 1 for p in (text.rfind(b, low, high) for b in _BLANKS) if p >= low)])

    def boundary(low: int, high: int) -> tuple[str, int]:
        """(level, place) of the last boundary of the coarsest level in (low, high]; -1 for none."""
        for level, at in (("paragraph", last(paragraphs, low, high)), ("sentence", last(sentences, low, high)), ("word", word_end(low, high))):
            if at > low:
                return level, at
        return "character", -1

    out: list[tuple[int, int, str]] = []
    begin = done = start  # the piece's start, with overlap; what earlier pieces hold
    while end - begin > limit:
        stop = begin + limit
        level, at = boundary(done, stop)
        if at < 0:
            # The overlap is given up only for a word that is whole without it, not for the rest of one that was cut.
            cut = bool(out) and out[-1][2] == "character"
            if begin < done and not cut and (end - done <= limit or boundary(done, done + limit)[1] > 0):
                begin = done
                continue
            pause = [m.end() for m in _PAUSE.finditer(text, done + limit // 2, stop)]
            at, level = pause[-1] if pause else _whole_character(text, stop, done), "character"
        out.append((begin, at, level))
        done = at
        if level == "character":
            begin = max(begin + 1, at - overlap)
        else:
            back = max(begin + 1, at - overlap)
            i = bisect_right(sentences, back - 1)
            begin = sentences[i] if i < len(sentences) and sentences[i] < at else at
            if begin == at:
                blanks = [p for p in (text.find(b, back, at) for b in _BLANKS) if p >= 0]
                begin = min(min(blanks) + 1, at) if blanks else at
        # The start of the next piece mustn't split a character from its marks either.
        while begin < at and (unicodedata.category(text[begin])[0] == "M" or text[begin] == "\u200d" or text[begin - 1] == "\u200d"):
            begin += 1
    out.append((begin, end, "section"))
    return out


def split_text(text: str, section: str | None, prefix: str = "", limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str, str]]:
    """(start, end, section, level) of all pieces of one item; its own headings where ``section`` is None."""
    spans = [(0, len(text), section)] if section is not None else sections(text, prefix)
    return [(a, b, label, level) for s, e, label in spans for a, b, level in pieces(text, s, e, limit, overlap)]


#: So many keys of items that came more than once are sent to all executors; more are joined by a shuffle.
SENT_KEYS = 1_000_000


def delivered_once(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` without repeated ones, with only the items shuffled whose ``key`` came more than once."""
    again = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(key))
    if again.limit(SENT_KEYS + 1).count() <= SENT_KEYS:
        again = F.broadcast(again)
    return rows.join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").distinct())


def split_oversized(
    items: DataFrame,
    key: str,
    text: str = "text",
    section: str | None = None,
    prefix: str | None = None,
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    with_text: bool = True,
    once: bool = False,
) -> DataFrame:
    """Pieces of at most ``limit`` characters (code points) of every item that is longer.

    An item is cut into its sections (headings of its text, or the one section of the column
    ``section``), a section that is too long at paragraphs, then sentences, then words, and only a
    run of more than ``limit`` characters without blank, tab or line end inside itself. Pieces are
    exact slices that cover the item; a piece repeats up to ``overlap`` characters of the one before
    in its section. No shuffle: the filter runs in the scan's stage and each row is cut where it is.

    Null, empty and short texts give no rows, null sections count as ``''``, a repeated row gives its
    pieces again unless ``once``, extra columns are ignored. ``overlap`` must be less than half of ``limit``.

    Returns ``item_id, piece_no int, start_pos int, end_pos int, section, cut_level, text``; ``cut_level``
    is that of the cut at the piece's end (``character`` for one inside an unbroken run). Without
    ``with_text`` the last column is left out.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and less than half of the limit")
    empty = F.lit("")
    rows = items.where(F.length(text) > limit).select(
        F.col(key).alias("item_id"),
        F.col(text).alias("text"),
        (F.coalesce(F.col(section), empty) if section else F.lit(None).cast("string")).alias("section"),
        (F.coalesce(F.col(prefix), empty) if prefix else empty).alias("prefix"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (item, n, a, b, label, level, *([body[a:b]] if with_text else []))
                for item, body, own, front in batch.itertuples(index=False)
                for n, (a, b, label, level) in enumerate(split_text(body, own, front, limit, overlap))
            ]
            yield pd.DataFrame(out, columns=names)

    kind = items.schema[key].dataType.simpleString()
    schema = f"item_id {kind}, piece_no int, start_pos int, end_pos int, section string, cut_level string" + ", text string" * with_text
    names = [part.split()[0] for part in schema.split(", ")]
    return spread(delivered_once(rows, "item_id") if once else rows).mapInPandas(run, schema)


def cut_kinds(pieces_of_items: DataFrame) -> DataFrame:
    """``item_id, cut_kind``: ``forced`` for an item with a cut inside an unbroken run, else ``natural``."""
    forced = F.max((F.col("cut_level") == "character").cast("int"))
    return pieces_of_items.groupBy("item_id").agg(F.when(forced == 1, "forced").otherwise("natural").alias("cut_kind"))
