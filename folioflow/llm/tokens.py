"""Encoding of a whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioflow.plans.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split that belongs to the vocabulary (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Memory of one Python worker for encoded words; when full it starts anew, results are the same.
REMEMBERED_WORDS = 400_000


class PairIndexEncoder:
    """Byte-pair merges over many words at once, driven by an index of pair positions.

    All words of a batch lie in one symbol array with links to the neighbours. An index maps each
    mergeable pair to every position it has; the active ranks are taken in ascending order, a pair's
    positions are merged together, and only the lists of the neighbouring pairs are updated. A merge
    creates pairs of higher rank only, so one ascending sweep equals merging word by word, and a
    word of n bytes costs O(n log n), not O(n^2).
    """

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.pair_ranks: dict[tuple[int, int], int] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(SPLIT)

    def rank(self, left: int, right: int) -> int:
        """The id that the pair merges to, -1 if none."""
        found = self.pair_ranks.get((left, right))
        if found is None:
            found = self.ranks.get(self.pieces[left] + self.pieces[right], -1)
            self.pair_ranks[(left, right)] = found
        return found

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word."""
        whole = [word.encode("utf-8", "surrogatepass") for word in words]
        result: list[tuple[int, ...] | None] = [None] * len(words)
        symbols: list[int] = []
        right: list[int] = []
        left: list[int] = []
        begins: list[tuple[int, int]] = []
        for n, data in enumerate(whole):
            known = self.ranks.get(data)
            if known is not None:
                result[n] = (known,)
                continue
            at = len(symbols)
            size = len(data)
            begins.append((n, at))
            symbols.extend(self.byte_ids[b] for b in data)
            right.extend(range(at + 1, at + size))
            right.append(-1)
            left.append(-1)
            left.extend(range(at, at + size - 1))
        index: dict[int, list[int]] = {}
        rank = self.rank
        for i, j in enumerate(right):
            if j >= 0 and (r := rank(symbols[i], symbols[j])) >= 0:
                index.setdefault(r, []).append(i)
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            places = index.pop(r)
            places.sort()
            for i in places:
                j = right[i]
                # A place may have gone stale: merged away, or its neighbour changed.
                if j < 0 or symbols[i] < 0 or rank(symbols[i], symbols[j]) != r:
                    continue
                symbols[i] = r
                symbols[j] = -1
                k = right[j]
                right[i] = k
                right[j] = -1
                if k >= 0:
                    left[k] = i
                    if (new := rank(r, symbols[k])) >= 0:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(active, new)
                h = left[i]
                if h >= 0 and (new := rank(symbols[h], r)) >= 0:
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        heapq.heappush(active, new)
        for n, at in begins:
            ids = []
            i = at
            while i >= 0:
                ids.append(symbols[i])
                i = right[i]
            result[n] = tuple(ids)
        return result

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; none for an empty or null text."""
        split = [self.split.findall(text) if text else [] for text in texts]
        known = self.words
        fresh = {word for words in split for word in words if word not in known}
        if len(known) + len(fresh) > REMEMBERED_WORDS:
            known.clear()
            fresh = {word for words in split for word in words}
        if fresh:
            listed = list(fresh)
            known.update(zip(listed, self.merge(listed)))
        ids = [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        return offsets, np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))


_encoders: dict[str, PairIndexEncoder] = {}


def _encoder(vocabulary: str) -> PairIndexEncoder:
    """One encoder per Python worker, kept between its batches and tasks."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = PairIndexEncoder(vocabulary)
    return _encoders[vocabulary]


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Token ids of every text: ``key, ids array<int>``, one row per input row.

    No shuffle: each partition streams through Arrow and keeps its own pair index. Empty and null
    texts give an empty list, strings of special tokens are ordinary text, a null key stays null,
    repeated rows are encoded again, an empty table gives an empty result. The path of the
    vocabulary is read by every worker and must exist on all of them.
    """
    source = spread(documents.select(key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                offsets, ids = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"]
                )

    return source.mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, ids array<int>")
