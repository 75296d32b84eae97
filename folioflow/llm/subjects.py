"""Subject areas of documents, from labelling functions whose accuracies are learnt together."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.hashing import groups_of, mix, powers
from folioflow.plans.runtime import cut, spread

AT_ONCE = 1_000_000
#: Raters that are functions of their own; all others are one together.
OWN_RATERS = 8
#: So many habits of sources (a short row each) are sent to all executors; more are joined by a shuffle.
SENT_HABITS = 200_000
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_BITS = 20


@dataclass(frozen=True)
class SubjectModel:
    """Parameters.

    The first lexicon is fitted on about ``most_labelled`` labelled documents, never more than twice as
    many; passes over all documents refine it, until at most a share of ``settled`` of its words changed
    or after ``most_rounds``, which is logged as a warning. It holds every word that qualifies; from more than ``most_terms`` on, its size
    is logged as a warning. ``levels`` are the bounds of the share of a document's sentences that the
    lexicon function reports.
    """

    most_labelled: int = 20_000
    most_rounds: int = 20
    settled: float = 0.03
    most_terms: int = 20_000
    seed_share: float = 0.45
    seed_least: int = 5
    term_share: float = 0.4
    term_least: int = 4
    levels: tuple[float, ...] = (0.0, 0.05, 0.1, 0.15, 0.2)
    section_share: float = 0.2
    section_least: int = 3
    steps: int = 100
    posterior: float = 0.5


class Sentences:
    """Words of many texts, with the sentence, paragraph and text that each stands in."""

    def __init__(self, texts: list[str]):
        data = [t.lower().replace("’", "'").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n\n".join(data) + b"\n\n    "
        buffer = np.frombuffer(self.raw, np.uint8)
        n = len(buffer)
        # Of bytes above 127 only letters count: those of quotes, dashes and blanks start with E2 or C2.
        inside = _INSIDE[buffer]
        lead = np.flatnonzero((buffer == 0xE2) | (buffer == 0xC2))
        inside[lead] = False
        inside[np.minimum(lead + 1, n - 1)] = False
        wide = lead[buffer[lead] == 0xE2]
        inside[np.minimum(wide + 2, n - 1)] = False
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        begins, ends = edges[::2], edges[1::2]
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        self.hashes = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
        self.begins, self.ends = begins, ends
        # A sentence ends at a line end, or at a mark, perhaps a closing quote, and a blank.
        line = (buffer == 10) | (buffer == 13)
        marks = np.flatnonzero((buffer == ord(".")) | (buffer == ord("!")) | (buffer == ord("?")))
        marks = marks[marks < n - 4]
        after = marks + 1
        quoted = (buffer[after] == 0xE2) & (buffer[after + 1] == 0x80)
        short = np.isin(buffer[after], np.frombuffer(b"\"')", np.uint8))
        after = after + 3 * quoted + short
        closed = after[np.isin(buffer[np.minimum(after, n - 1)], np.frombuffer(b" \t", np.uint8))]
        stops = line.copy()
        stops[closed] = True
        paragraph = line.copy()
        paragraph[1:] &= line[:-1]
        paragraph[0] = False
        self.sentence = np.cumsum(stops)[begins] if n else begins
        self.paragraph = np.cumsum(paragraph)[begins] if n else begins
        limits = np.cumsum([len(d) + 2 for d in data])
        self.text = np.searchsorted(limits, begins, side="right")
        # Numbered from 0 without gaps.
        self.sentence = np.cumsum(np.append(0, (np.diff(self.sentence) != 0))[: len(begins)])
        self.paragraph = np.cumsum(np.append(0, (np.diff(self.paragraph) != 0))[: len(begins)])

    def word(self, i: int) -> str:
        return self.raw[self.begins[i] : self.ends[i]].decode("utf-8", "replace")


@dataclass
class Slice:
    """The words of a slice of documents as places in its vocabulary, with the sentences they stand in."""

    vocabulary: np.ndarray  # sorted 64-bit hashes of the different words
    codes: np.ndarray  # of each word, its place in the vocabulary
    sentence: np.ndarray  # of each word
    paragraph: np.ndarray  # of each sentence
    text: np.ndarray  # of each sentence

    @staticmethod
    def pack(s: Sentences) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        """Two bytes for most words: a slice has few different ones."""
        vocabulary, codes = np.unique(s.hashes, return_inverse=True)
        first = np.flatnonzero(np.append(True, np.diff(s.sentence) != 0))[: len(s.sentence)]
        lengths = np.diff(np.append(first, len(s.sentence)))
        small = np.uint16 if len(vocabulary) < 1 << 16 else np.uint32
        places = (lengths, s.paragraph[first], s.text[first])
        return vocabulary.tobytes(), codes.astype(small).tobytes(), *(x.astype(np.uint32).tobytes() for x in places)

    @classmethod
    def unpack(cls, vocabulary: bytes, codes: bytes, lengths: bytes, paragraph: bytes, text: bytes) -> Slice:
        known = np.frombuffer(vocabulary, np.uint64)
        words = np.frombuffer(codes, np.uint16 if len(known) < 1 << 16 else np.uint32).astype(np.int64)
        per = np.frombuffer(lengths, np.uint32)
        return cls(known, words, np.repeat(np.arange(len(per)), per), *(np.frombuffer(x, np.uint32).astype(np.int64) for x in (paragraph, text)))

    def tally(self, at: np.ndarray, marks: np.ndarray, n: int) -> pd.DataFrame:
        """``word`` (its hash), ``n`` occurrences among the words at ``at``, and of these by subject; a mark is a subject or a row of 0 and 1."""
        size = len(self.vocabulary)
        codes = self.codes[at]
        if marks.ndim == 1:
            used = marks >= 0
            by = np.bincount(codes[used] * n + marks[used], minlength=size * n).reshape(size, n)
        else:
            by = np.stack([np.bincount(codes, marks[:, k], size) for k in range(n)], axis=1).astype(np.int64)
        total = np.bincount(codes, minlength=size)
        held = np.flatnonzero(total)
        return pd.DataFrame({"word": self.vocabulary[held].view(np.int64), "n": total[held]} | {f"s{k}": by[held, k] for k in range(n)})


def word_hash(words: list[str]) -> np.ndarray:
    """The hash that each of the words has within a text; a string of several words has that of the first."""
    s = Sentences(words)
    return s.hashes[np.searchsorted(s.text, np.arange(len(words)))] if words else np.zeros(0, np.uint64)


class Lexicon:
    """Hashes of words, and the one subject that each speaks for: 16 bytes a word."""

    def __init__(self, subject_of: dict[int, int]):
        hashes = np.array(list(subject_of), np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.subject_of = subject_of
        self.hashes, self.subject = hashes[order], np.array(list(subject_of.values()), np.int64)[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.hashes >> np.uint64(64 - _BITS)] = True

    @classmethod
    def of_words(cls, words: list[tuple[str, int]]) -> Lexicon:
        return cls(dict(zip(word_hash([w for w, _ in words]).view(np.int64).tolist(), (k for _, k in words))))

    def __getstate__(self) -> dict:
        """What tasks need."""
        return self.__dict__ | {"subject_of": {}}

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The subject of each word, -1 for none."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            may = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _BITS)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[may]), len(self.hashes) - 1)
            out[may] = np.where(self.hashes[at] == hashes[may], self.subject[at], -1)
        return out


def majority(counts: np.ndarray) -> np.ndarray:
    """The column of the highest count in each row, -1 where there is none or a tie."""
    best = counts.argmax(axis=1)
    rows = np.arange(len(counts))
    top = counts[rows, best]
    tie = (counts == top[:, None]).sum(axis=1) > 1
    return np.where((top > 0) & ~tie, best, -1)


def _votes(s: Slice, subject: np.ndarray, n: int) -> np.ndarray:
    used = subject >= 0
    total = len(s.text)
    return np.bincount(s.sentence[used] * n + subject[used], minlength=total * n).reshape(total, n).astype(np.int32)


def _summed(counts: DataFrame, n: int) -> DataFrame:
    return counts.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(n)])


def _chosen(counts: DataFrame, n: int, share: float, least: int, many: int) -> dict[int, int]:
    """Words of which at least ``share`` of the occurrences speak for one subject, with that subject (the first of equals)."""
    by = [F.col(f"s{k}") for k in range(n)]
    top = F.greatest(*by) if n > 1 else by[0]
    best = F.array_position(F.array(*by), top).cast("int") - 1
    # Only hashes and numbers come to the driver: the part of the vocabulary that is bound to a subject.
    rows = counts.where(top >= least).where(top / F.col("n") >= share).select("word", best.alias("subject")).collect()
    if len(rows) > many:
        logging.getLogger(__name__).warning("the lexicon has %d words, more than %d; all are kept", len(rows), many)
    return {r["word"]: r["subject"] for r in rows}


_PACKED = ("vocabulary", "codes", "lengths", "paragraphs", "texts")


def packed_words(texts: DataFrame) -> DataFrame:
    """(doc_id, text, source, address) -> ``doc_ids, sources, addresses`` and the packed ``Slice`` of each million characters or so.

    The one pass over the texts; all later ones read these rows, of about two bytes a word.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_ids array<{kind}>, sources array<string>, addresses array<string>, " + ", ".join(f"{c} binary" for c in _PACKED)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch["text"].tolist()
            for a, b in groups_of([len(t) for t in whole], AT_ONCE):
                part = batch.iloc[a:b]
                # A slice at a time, so that a task holds no more than one.
                row = (part["doc_id"].tolist(), part["source"].tolist(), part["address"].tolist(), *Slice.pack(Sentences(whole[a:b])))
                yield pd.DataFrame([row], columns=names)

    return texts.select("doc_id", "text", "source", "address").mapInPandas(run, schema)


def clean_labels(labels: DataFrame, names: list[str], doc_id: str = "doc_id", subject: str = "subject", rater: str = "rater") -> DataFrame:
    """``doc_id, rater, subject int`` of labels that can be read (case and blanks ignored); -1 for ``none``."""
    place = F.array_position(F.array(*[F.lit(x.strip().lower()) for x in names]), F.lower(F.trim(F.col(subject)))).cast("int") - 1
    given = F.lower(F.trim(F.col(subject)))
    return (
        labels.where(F.col(doc_id).isNotNull() & F.col(subject).isNotNull())
        .select(F.col(doc_id).alias("doc_id"), F.coalesce(F.lower(F.trim(F.col(rater))), F.lit("?")).alias("rater"), F.when(given == "none", -1).otherwise(F.when(place >= 0, place)).alias("subject"))
        .where("subject is not null")
        .distinct()
    )


def described(descriptions: list[tuple[str, str | None]]) -> list[tuple[str, int]]:
    """Words of the subjects' names and descriptions that only one of them has, also without a plural s."""
    of: dict[str, set[int]] = {}
    for k, (name, text) in enumerate(descriptions):
        s = Sentences([f"{name} {text or ''}"])
        for word in {s.word(i) for i in range(len(s.hashes))}:
            for form in {word, word.removesuffix("s")}:
                if len(form) > 3:
                    of.setdefault(form, set()).add(k)
    return [(word, k) for word, (k, *more) in sorted(of.items()) if not more]


def fit_lexicon(words: DataFrame, labels: DataFrame, descriptions: list[tuple[str, str | None]], m: SubjectModel) -> Lexicon:
    """A lexicon from ``packed_words`` and cleaned labels, refined over all of them.

    First, words are counted by document and label over a bounded sample of labelled documents, and
    words of the subjects' descriptions are added. Then
    every slice is read: each sentence is given the subject that most of its lexicon words speak
    for, and each of its words is counted under the subject of the sentence's *other* words, so that
    no word confirms itself. Counts are combined in the tasks and summed by word in one shuffle.
    """
    n = len(descriptions)
    schema = "word bigint, n bigint, " + ", ".join(f"s{k} bigint" for k in range(n))
    by_doc = labels.groupBy("doc_id").agg(F.collect_set("subject").alias("marks"))
    there = by_doc.count()
    share = min(1.0, m.most_labelled / max(1, there))
    sample = by_doc.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * m.most_labelled)
    context = words.sparkSession.sparkContext
    marked = context.broadcast({r["doc_id"]: [k for k in r["marks"] if k >= 0] for r in sample.collect()})

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of: dict = marked.value
        for batch in batches:
            for ids, *packed in batch.itertuples(index=False):
                given = [of.get(i) for i in ids]
                chosen = np.array([g is not None for g in given], bool)
                if not chosen.any():
                    continue
                s = Slice.unpack(*packed)
                marks = np.zeros((len(given), n))
                for i, g in enumerate(given):
                    marks[i, g or []] = 1
                text = s.text[s.sentence]
                at = np.flatnonzero(chosen[text])
                # Each different word of a document once.
                at = at[np.unique(text[at] * max(1, len(s.vocabulary)) + s.codes[at], return_index=True)[1]]
                yield s.tally(at, marks[text[at]], n)

    seeds = _summed(words.select("doc_ids", *_PACKED).mapInPandas(labelled, schema), n)
    lexicon = Lexicon(Lexicon.of_words(described(descriptions)).subject_of | _chosen(seeds, n, m.seed_share, m.seed_least, m.most_terms))

    for _ in range(m.most_rounds):
        shared = context.broadcast(lexicon)

        def refined(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known: Lexicon = shared.value
            for batch in batches:
                for packed in batch.itertuples(index=False):
                    s = Slice.unpack(*packed)
                    subject = known.of(s.vocabulary)[s.codes]
                    others = _votes(s, subject, n)[s.sentence]
                    own = np.flatnonzero(subject >= 0)
                    others[own, subject[own]] -= 1
                    yield s.tally(np.arange(len(s.codes)), majority(others), n)

        counts = _summed(words.select(*_PACKED).mapInPandas(refined, schema), n)
        before, lexicon = lexicon, Lexicon(_chosen(counts, n, m.term_share, m.term_least, m.most_terms))
        changed = len(before.subject_of.items() ^ lexicon.subject_of.items())
        if changed <= m.settled * max(1, len(before.subject_of)):
            break
    else:
        logging.getLogger(__name__).warning("the lexicon still changed by %d words in the last of %d rounds", changed, m.most_rounds)
    return lexicon


def accuracy_model(patterns: list[tuple[tuple[int, ...], float]], ordered: int, always: int, m: SubjectModel) -> dict[tuple[int, ...], float]:
    """Posterior of each pattern of votes, by expectation maximisation over two hidden classes.

    A pattern is one value for each labelling function. Given the class, the functions are taken as
    independent; how often each gives each value is learnt for both classes, from all patterns with
    their counts. The first ``always`` functions look at every document; the others are raters, whose 0
    means that they didn't look and says nothing. The first function's value is a level of evidence
    (0 .. ``ordered`` - 1); only the start of the iteration uses that order.
    """
    values = np.array([p for p, _ in patterns])
    weight = np.array([w for _, w in patterns], float)
    q = np.clip(0.02 + 0.96 * (values[:, 0] / max(1, ordered - 1)), 0.02, 0.98) ** 2
    sizes = [int(values[:, j].max()) + 1 for j in range(values.shape[1])]
    for _ in range(m.steps):
        log = np.zeros((2, len(weight)))
        for c, p in enumerate((1 - q, q)):
            held = weight * p
            log[c] += np.log((held.sum() + 1) / (weight.sum() + 2))
            for j, size in enumerate(sizes):
                vote = (values[:, j] > 0) | (j < always)
                rate = (np.bincount(values[vote, j], held[vote], size) + 0.1) / (held[vote].sum() + 0.1 * size)
                log[c, vote] += np.log(rate[values[vote, j]])
        after = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(after - q).max() < 1e-9:
            break
        q = after
    return {p: float(x) for (p, _), x in zip(patterns, q)}


def document_subjects(
    documents: DataFrame,
    subjects: DataFrame,
    labels: DataFrame,
    m: SubjectModel = SubjectModel(),
    doc_id: str = "doc_id",
    text: str = "text",
    title: str = "title",
    source: str = "source",
) -> DataFrame:
    """``doc_id, subject, share, posterior`` of every document and subject it is about.

    Labelling functions for each document and subject: the lexicon's share of sentences; whether
    ``m.section_share`` of its sentences stand in paragraphs of ``m.section_least`` sentences or more that
    are mostly about it; words of title and source name (its address); how often documents of its
    source are about it; the labels of each of the eight raters with most of them; and the labels of all
    other raters together, by whether none, fewer than half or more of those who labelled the
    document name the subject. The numbers of documents by pattern
    of votes are aggregated over the whole corpus, the accuracies of the functions are learnt from them
    without knowing the truth, and a document has the subjects of posterior ``m.posterior`` or more.

    The subjects (a small fixed table) and the lexicon (16 bytes for each word bound to a subject) travel
    with the tasks; texts are read and split into words once and never shuffled. Null, empty and wordless texts
    have no subject; null titles, sources and raters abstain; labels of unknown subjects or documents
    are ignored, doubled ones count once; extra columns are ignored.
    """
    meaning = {r[0].strip(): r[1] for r in subjects.select("subject", "description").collect() if r[0]}
    names = sorted(meaning)
    n = len(names)
    source_name = F.coalesce(F.col(source), F.lit(""))
    every = spread(
        documents.where(F.length(text) > 0).select(
            F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.concat_ws(" ", F.col(title), source_name).alias("address"), source_name.alias("source")
        )
    )
    if not n:
        return every.select("doc_id", F.lit(None).cast("string").alias("subject"), F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("posterior")).limit(0)
    given = cut(clean_labels(labels, names))
    words = cut(packed_words(every))
    lexicon = documents.sparkSession.sparkContext.broadcast(fit_lexicon(words, given, [(x, meaning[x]) for x in names], m))

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Lexicon = lexicon.value
        for batch in batches:
            for ids, sources, addresses, *packed in batch.itertuples(index=False):
                s = Slice.unpack(*packed)
                if not len(s.codes):
                    continue
                size = len(ids)
                about = majority(_votes(s, known.of(s.vocabulary)[s.codes], n))
                sentences = np.bincount(s.text, minlength=size)
                used = about >= 0
                held = np.bincount(s.text[used] * n + about[used], minlength=size * n).reshape(-1, n)
                total = int(s.paragraph[-1]) + 1
                in_paragraph = np.bincount(s.paragraph[used] * n + about[used], minlength=total * n).reshape(-1, n)
                length = np.bincount(s.paragraph, minlength=total)
                mostly = (in_paragraph * 2 >= length[:, None]) & (length[:, None] >= m.section_least)
                begin = np.flatnonzero(np.append(True, np.diff(s.paragraph) != 0))
                filled = np.zeros((size, n))
                np.add.at(filled, s.text[begin], mostly * length[:, None])
                address = np.zeros((size, n), int)
                a = Sentences(list(addresses))
                spoken = known.of(a.hashes)
                address[a.text[spoken >= 0], spoken[spoken >= 0]] = 1
                i, k = np.nonzero(((held > 0) | (address > 0)) & (sentences[:, None] > 0))
                if not len(i):
                    continue
                yield pd.DataFrame(
                    {
                        "doc_id": [ids[x] for x in i], "source": [sources[x] for x in i], "subject": k,
                        "share": held[i, k] / sentences[i], "filled": filled[i, k] / sentences[i], "address": address[i, k],
                    }
                )

    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, source string, subject int, share double, filled double, address int"
    seen = cut(words.select("doc_ids", "sources", "addresses", *_PACKED).mapInPandas(shares, schema))
    docs = cut(words.select(F.explode(F.arrays_zip("doc_ids", "sources")).alias("d")).select(F.col("d.doc_ids").alias("doc_id"), F.col("d.sources").alias("source")))

    # How much oftener than elsewhere documents of a source are clearly about a subject.
    clear = F.col("share") >= m.levels[-1]
    per = seen.where(clear & (F.col("source") != "")).groupBy("source", "subject").agg(F.count(F.lit(1)).alias("hits"))
    sizes = docs.where("source <> ''").groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    # One row per subject, so no more than the subjects table has.
    overall = per.groupBy("subject").agg(F.sum("hits").alias("all_hits")).withColumn("rows", F.lit(1))
    named = docs.where("source <> ''").agg(F.count(F.lit(1)).alias("all_docs"))
    lift = (F.col("hits") + 1) / (F.col("size") * F.col("all_hits") / F.col("all_docs") + 1)
    habit = cut(
        per.join(sizes, "source").join(F.broadcast(overall), "subject").join(F.broadcast(named))
        .select("source", "subject", F.when(lift >= 2, 2).when(lift <= 0.5, 1).otherwise(0).alias("habit"))
        .where("habit > 0")
    )
    # One source may have most of the documents, so they stay where they are while the habits can be sent.
    if habit.limit(SENT_HABITS + 1).count() <= SENT_HABITS:
        habit = F.broadcast(habit)

    raters = [r[0] for r in given.groupBy("rater").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rater").limit(OWN_RATERS + 1).collect()]
    raters, pooled = raters[:OWN_RATERS], len(raters) > OWN_RATERS
    # One row per labelled document and subject: 2 a rater's yes, 1 the no of a rater who gave other labels.
    by_doc = given.groupBy("doc_id").agg(*[F.collect_set(F.when(F.col("rater") == r, F.col("subject"))).alias(f"r{i}") for i, r in enumerate(raters)]) if raters else None
    joined = seen.join(habit, ["source", "subject"], "left")
    if raters:
        named_by = [F.col(f"r{i}") for i in range(len(raters))]
        opinions = [
            F.when(F.array_contains(f"r{i}", F.col("subject")), 2).when(F.size(f"r{i}") > 0, 1).otherwise(0).alias(f"v{i}") for i in range(len(raters))
        ]
        if pooled:
            # Counted by subject, so a document with any number of raters stays small.
            others = given.where(~F.col("rater").isin(raters))
            yes = others.groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("yes"))
            yes = yes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("subject", "yes"))).alias("rest"))
            by_doc = by_doc.join(yes, "doc_id", "left").join(others.groupBy("doc_id").agg(F.count_distinct("rater").alias("rest_raters")), "doc_id", "left")
            named_by.append(F.coalesce(F.map_keys("rest"), F.array().cast("array<int>")))
            votes = F.coalesce(F.try_element_at("rest", F.col("subject")), F.lit(0))
            half = votes * 2 >= F.col("rest_raters")
            opinions.append(F.when(F.col("rest_raters").isNull(), 0).when(votes == 0, 1).when(half, 3).otherwise(2).alias("rest_vote"))
        said = by_doc.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*named_by)))).alias("subject"), F.lit(True).alias("labelled"))
        known_docs = docs.select("doc_id").distinct()
        extra = said.where("subject >= 0").join(known_docs, "doc_id", "left_semi").select("doc_id", "subject")
        joined = joined.join(extra.withColumn("labelled", F.lit(True)), ["doc_id", "subject"], "full").join(by_doc, "doc_id", "left")
    else:
        opinions = []
    share = F.coalesce("share", F.lit(0.0))
    level = sum((share > b).cast("int") for b in m.levels)
    filled = F.coalesce("filled", F.lit(0.0))
    functions = [
        level.alias("level"),
        (filled >= m.section_share).cast("int").alias("section"),
        F.coalesce("address", F.lit(0)).alias("address"),
        F.coalesce("habit", F.lit(0)).alias("habit"),
        *opinions,
    ]
    voted = cut(joined.select("doc_id", "subject", share.alias("share"), *functions))
    columns = [c for c in voted.columns if c not in ("doc_id", "subject", "share")]
    patterns = [(tuple(r[c] for c in columns), float(r["count"])) for r in voted.groupBy(*columns).count().collect()]
    silent = float(docs.count() * n - sum(w for _, w in patterns))
    nothing = tuple([0] * len(columns))
    posterior = accuracy_model([*patterns, *([(nothing, silent)] if silent > 0 else [])], len(m.levels) + 1, 4, m) if patterns or silent > 0 else {}
    kept = [(*p, x) for p, x in posterior.items() if x >= m.posterior]
    fields = ", ".join(f"{c} int" for c in columns)
    table = documents.sparkSession.createDataFrame(kept, f"{fields}, posterior double")
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("subject") + 1)
    # No more rows than there are combinations of votes.
    return voted.join(F.broadcast(table), columns).select("doc_id", label.alias("subject"), "share", "posterior").dropDuplicates(["doc_id", "subject"])
