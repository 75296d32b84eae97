"""Evaluation texts that stand, whole or in part, in a corpus."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.plans.runtime import spread

#: Characters of documents that are filtered together, and the longest stretch of one document that is
#: looked at in one piece (longer ones are looked at in stretches that overlap by the longest item).
AT_ONCE = 1_000_000
#: Characters of items that one pass holds in each task, at some 35 bytes each; more items are taken in several passes.
ITEMS_AT_ONCE = 4_000_000
_BASE = 0x9E3779B97F4A7C15
_BITS = 22

_UNSEEN = regex.compile(r"[\p{Cf}\ufe00-\ufe0f\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180e\u3164\uffa0*_`~\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]+")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: The same where no text holds a mark of its own, which is faster to find.
_LETTERS = re.compile(r"[^\W_]+")
_MARKS = regex.compile(r"\p{M}")
_PLAIN = regex.compile(r"[\u0130\u1e9e\u212a\u212b\u2126\p{Cf}\p{M}\ufe00-\ufe0f\u115f\u1160\u3164\uff01-\uff5e\uffa0*_`~\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]")


def reader_words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased and composed, without emphasis marks and unseen characters."""
    if not text:
        return []
    if not _PLAIN.search(text) and unicodedata.is_normalized("NFC", text):
        return _LETTERS.findall(text.lower())
    text = unicodedata.normalize("NFC", _UNSEEN.sub("", text.translate(_WIDE)).lower())
    return (_WORDS if _MARKS.search(text) else _LETTERS).findall(text)


def spaced(words: list[str]) -> str:
    return f" {' '.join(words)} "


def within_edits(a: str, b: str, most: int, budget: int) -> int:
    """The least edit distance of ``a`` to any stretch of ``b``, by a band of diagonals; above ``budget`` if there is none.

    ``b`` starts ``most`` characters before where ``a`` is expected, so only 2 x most + 1 diagonals on
    either side can hold an alignment within ``most`` edits. An alignment without edits keeps to one diagonal, so
    for a budget of 0 each is compared whole, and only with more the band is filled in.
    """
    if any(b.startswith(a, k) for k in range(2 * most + 1)):
        return 0
    if not budget:
        return most + 1
    width = 4 * most + 1
    row = [0 if k <= 2 * most else budget + 1 for k in range(width)]
    for i, c in enumerate(a):
        after = [budget + 1] * width
        for k in range(width):
            j = i + k
            best = row[k] + (j >= len(b) or b[j] != c)
            if k + 1 < width:
                best = min(best, row[k + 1] + 1)
            if k:
                best = min(best, after[k - 1] + 1)
            after[k] = min(best, budget + 1)
        row = after
        if min(row) > budget:
            return budget + 1
    return min(row)


def rolling(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of ``q`` (a power of two) characters."""
    h, n = codes.astype(np.uint64), 1
    while n < q:
        if len(h) <= n:
            return h[:0]
        h = h[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + h[n:]
        n *= 2
    return h


@dataclass
class _Grams:
    """The q-grams of the items that use this q, sorted, with where they occur."""

    q: int
    least: int  # the fewest grams that a match of any of these items shares, and the span they lie in
    span: int
    values: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray


@dataclass
class ItemIndex:
    """What a pass knows of its items: their windows of words, and their grams by length."""

    words: int
    edits: int
    ids: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    windows: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    least: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    grams: list[_Grams] = field(default_factory=list)

    @classmethod
    def build(cls, items: list[tuple[int, str | None]], words: int, edits: int) -> ItemIndex:
        self = cls(words, edits)
        by_q: dict[int, list[int]] = {}
        for item_id, text in sorted({(i, spaced(w)) for i, t in items if i is not None and (w := reader_words(t))}):
            ends = [k for k, c in enumerate(text) if c == " "]
            run = min(words, len(ends) - 1)
            windows = [(ends[k], ends[k + run] + 1) for k in range(len(ends) - run)]
            shortest = min(b - a for a, b in windows)
            # The lemma: a window of w characters with up to e edits keeps w + 1 - q - q e of its grams.
            q = 16
            while q > 1 and shortest + 1 - q * (edits + 1) < max(1, q // 2):
                q //= 2
            by_q.setdefault(q, []).append(len(self.ids))
            self.ids.append(item_id)
            self.texts.append(text)
            self.windows.append((np.array([a for a, _ in windows]), np.array([b for _, b in windows])))
            self.size.append(q)
            self.least.append(max(1, shortest + 1 - q * (edits + 1)))
        for q, members in by_q.items():
            hashes, owner, at = [], [], []
            for n in members:
                h = rolling(np.frombuffer(self.texts[n].encode("utf-32-le"), np.uint32), q)
                hashes.append(h)
                owner.append(np.full(len(h), n))
                at.append(np.arange(len(h)))
            h, owner, at = np.concatenate(hashes), np.concatenate(owner), np.concatenate(at)
            order = np.argsort(h, kind="stable")
            values, starts = np.unique(h[order], return_index=True)
            seen = np.zeros(1 << _BITS, bool)
            seen[self.slot(values)] = True
            shortest = min(int((self.windows[n][1] - self.windows[n][0]).min()) for n in members)
            self.grams.append(
                _Grams(q, min(self.least[n] for n in members), shortest + edits + 1 - q, values, np.append(starts, len(h)), owner[order], at[order], seen)
            )
        return self

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)

    @property
    def longest(self) -> int:
        return max(map(len, self.texts), default=0)

    def regions(self, codes: np.ndarray, g: _Grams) -> tuple[np.ndarray, np.ndarray]:
        """(position, gram) of the hits that lie in a stretch dense enough for a match of any item."""
        h = rolling(codes, g.q)
        where = np.flatnonzero(g.seen[self.slot(h)])
        if not len(where):
            return where, where
        gram = np.searchsorted(g.values, h[where])
        gram[gram == len(g.values)] = 0
        real = g.values[gram] == h[where]
        where, gram = where[real], gram[real]
        # Of hits i .. i + least - 1 within one span, all may belong to a match.
        if len(where) < g.least:
            return where[:0], gram[:0]
        dense = where[g.least - 1 :] - where[: len(where) - g.least + 1] <= g.span + self.edits
        marks = np.zeros(len(where) + 1, np.int32)
        begins = np.flatnonzero(dense)
        np.add.at(marks, begins, 1)
        np.add.at(marks, begins + g.least, -1)
        keep = np.cumsum(marks[:-1]) > 0
        return where[keep], gram[keep]

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(index of the text, item id, edits) of the items that the texts hold within the budget."""
        whole = "\0".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        limits = np.cumsum([len(t) + 1 for t in texts])
        band = 2 * self.edits + 2
        least = np.array(self.least)
        found: dict[tuple[int, int], int] = {}
        for g in self.grams:
            where, gram = self.regions(codes, g)
            if not len(where):
                continue
            counts = g.starts[gram + 1] - g.starts[gram]
            for a, b in _runs(counts, 4_000_000, np.searchsorted(limits, where, side="right")):
                n = counts[a:b]
                x = np.repeat(where[a:b], n)
                slot = np.repeat(g.starts[gram[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                item, y = g.item[slot], g.at[slot]
                text = np.searchsorted(limits, x, side="right")
                diagonal = x - y + self.longest
                # Two families of bands, shifted by half a band: any e + 1 diagonals lie within one.
                for shift in (0, band // 2):
                    key = (text * len(self.ids) + item) * (len(codes) + 2 * self.longest + band) + (diagonal + shift) // band
                    order = np.argsort(key, kind="stable")
                    ordered = key[order]
                    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                    sizes = np.diff(np.append(starts, len(ordered)))
                    enough = sizes >= least[item[order[starts]]]
                    for s, size in zip(starts[enough].tolist(), sizes[enough].tolist()):
                        n_item, n_text = int(item[order[s]]), int(text[order[s]])
                        known = found.get((n_text, n_item))
                        if known == 0:
                            continue
                        rows = order[s : s + size]
                        edits = self.verify(whole, n_item, x[rows], y[rows])
                        if edits <= self.edits and (known is None or edits < known):
                            found[n_text, n_item] = edits
        return [(text, self.ids[item], edits) for (text, item), edits in found.items()]

    def verify(self, whole: str, n: int, x: np.ndarray, y: np.ndarray) -> int:
        """The fewest edits by which a window of the item stands along these diagonals of the text."""
        text, q = self.texts[n], self.size[n]
        order = np.argsort(y, kind="stable")
        x, y = x[order], y[order]
        begins, ends = self.windows[n]
        i, j = np.searchsorted(y, begins), np.searchsorted(y, ends - q, side="right")
        windows = []
        for k in np.flatnonzero(j - i >= np.maximum(1, ends - begins + 1 - q * (self.edits + 1))):
            a, b = int(begins[k]), int(ends[k])
            low = int(x[i[k]] - y[i[k]]) + a - self.edits
            windows.append(("\0" * max(0, -low), text[a:b], max(0, low), low + b - a + 3 * self.edits))
        # All windows are aligned for no edits before any is for some, as most that leak do so word for word.
        best = self.edits + 1
        for budget in sorted({0, self.edits}):
            for pad, window, low, high in windows:
                best = min(best, within_edits(window, pad + whole[low:high], self.edits, budget))
                if best <= (1 if budget else 0):
                    return best
        return best if best <= self.edits else self.edits + 1


def _runs(counts: np.ndarray, most: int, text: np.ndarray) -> list[tuple[int, int]]:
    """Cuts of the hits, between texts, so that each has about ``most`` places in the items at the most."""
    total = np.cumsum(counts)
    cuts = [0]
    while cuts[-1] < len(counts):
        base = total[cuts[-1] - 1] if cuts[-1] else 0
        end = int(np.searchsorted(total, base + most, side="right"))
        end = max(end, cuts[-1] + 1)
        if end < len(counts):
            first = int(np.searchsorted(text, text[end]))
            end = first if first > cuts[-1] else int(np.searchsorted(text, text[cuts[-1]], side="right"))
        cuts.append(end)
    return list(zip(cuts[:-1], cuts[1:]))


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    words: int = 12,
    edits: int = 1,
) -> DataFrame:
    """``doc_id, item_id, edits``: documents in which ``words`` consecutive words of an item stand.

    Of items with fewer words all must stand. Words are runs of letters and digits as a reader sees
    them: lower-cased, composed, full-width letters as ordinary ones, without emphasis marks and
    characters that print nothing; accents count. ``edits`` is the least number of character edits
    (0: verbatim) over the item's windows, up to the given budget.

    The items are the stated query set: they are read to the driver in passes of a fixed number of
    characters and travel with the tasks. Documents never move: each batch is filtered by q-grams
    (16 characters, fewer for short items): only stretches with as many shared grams as the lemma
    demands of a match are compared with item positions, counted in overlapping bands of diagonals,
    and what is left is verified by banded alignment, for no edits first. The result alone is shuffled, to be distinct.

    Null and empty texts and texts without words give no rows, nor do items without words; repeated
    rows count once; very long texts are looked at whole, in overlapping stretches; extra columns are
    ignored.
    """
    if words < 1 or edits < 0:
        raise ValueError("words must be 1 or more and edits 0 or more")
    chosen = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).where("text is not null and item_id is not null")
    chars = chosen.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = int(chars // ITEMS_AT_ONCE) + 1
    source = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null"))
    kind = documents.schema[doc_id].dataType.simpleString()
    out = None
    for n in range(passes):
        block = chosen if passes == 1 else chosen.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n)
        index = documents.sparkSession.sparkContext.broadcast(ItemIndex.build([tuple(r) for r in block.collect()], words, edits))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            known: ItemIndex = index.value
            if not known.ids:
                return
            for batch in batches:
                found = []
                owners, texts, held = [], [], 0
                for owner, body in zip(batch.doc_id, batch.text):
                    form = spaced(reader_words(body))
                    for start in range(0, max(1, len(form) - known.longest), AT_ONCE):
                        owners.append(owner)
                        texts.append(form[start : start + AT_ONCE + 2 * known.longest])
                        held += len(texts[-1])
                    if held >= AT_ONCE:
                        found.extend((owners[t], i, e) for t, i, e in known.leaks(texts))
                        owners, texts, held = [], [], 0
                if texts:
                    found.extend((owners[t], i, e) for t, i, e in known.leaks(texts))
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "edits"])

        part = source.mapInPandas(run, f"doc_id {kind}, item_id bigint, edits int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
