import random

from folioflow.llm import subjects as module
from folioflow.llm.subjects import Lexicon, Sentences, Slice, SubjectModel, accuracy_model, clean_labels, document_subjects, fit_lexicon, majority, packed_words, word_hash

import numpy as np

WORDS = {
    "law": "court statute verdict bailiff jury appeal clause tribunal".split(),
    "music": "lute chorus fugue cadence harp ballad tempo piper".split(),
    "trade": "broker auction tariff debt merchant ledger surplus toll".split(),
}
FILLER = "the grey door stood open near a quiet stair and nobody came by lamplight while rain fell on cold stone".split()


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, truth, labels = [], set(), []
    for i in range(n):
        chosen = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 2]))
        sentences = []
        for s in chosen:
            for _ in range(6):
                sentences.append(" ".join(rng.sample(FILLER, 4) + rng.sample(WORDS[s], 3)))
        passing = rng.choice(sorted(WORDS)) if rng.random() < 0.3 else None
        sentences += [" ".join(rng.sample(FILLER, 6)) for _ in range(16 - len(sentences))]
        if passing and passing not in chosen:
            sentences[-1] += " " + rng.choice(WORDS[passing])
        rng.shuffle(sentences)
        docs.append((i, ". ".join(x.capitalize() for x in sentences) + ".", "Grey Door", f"s{i % 3}", "extra"))
        truth |= {(i, s) for s in chosen}
        if i % 3 == 0:
            for s in chosen or ["none"]:
                given = rng.choice(sorted(WORDS)) if rng.random() < 0.1 else s
                labels.append((i, rng.choice([given, given.upper(), f"{given} "]), f"r{i % 2}"))
    return docs, truth, labels


DOCS = "doc_id bigint, text string, title string, source string, share string"
LABELS = "doc_id bigint, subject string, rater string"


def found(spark, docs, labels, subjects=None):
    subjects = spark.createDataFrame([(s, f"about {s}") for s in sorted(WORDS)] if subjects is None else subjects, "subject string, description string")
    out = document_subjects(spark.createDataFrame(docs, DOCS), subjects, spark.createDataFrame(labels, LABELS))
    rows = [(r.doc_id, r.subject) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_sentences_and_paragraphs():
    s = Sentences(["Zoë’s door. “Was it?” asked he! “No.” So\n\nmid-day… end", "", "x"])
    words = [s.word(i) for i in range(len(s.hashes))]
    assert words == ["zoë", "s", "door", "was", "it", "asked", "he", "no", "so", "mid", "day", "end", "x"]
    assert s.text.tolist() == [0] * 12 + [2]
    assert s.paragraph.tolist() == [0] * 9 + [1] * 3 + [2]
    assert s.sentence.tolist()[:3] == [0, 0, 0] and s.sentence[3] == 1 and s.sentence[7] > s.sentence[6]


def test_lexicon_and_majority():
    lexicon = Lexicon.of_words([("court", 0), ("lute", 1)])
    assert lexicon.of(Sentences(["Court lute, other"]).hashes).tolist() == [0, 1, -1]
    assert majority(np.array([[2, 1], [1, 1], [0, 0], [0, 3]])).tolist() == [0, -1, -1, 1]


def test_accuracies_separate_good_from_random_raters():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.3
        level = 4 if (rng.random() < 0.9) == y else 0
        good = 2 if (rng.random() < 0.9) == y else 1
        noise = rng.choice([1, 2])
        counts[level, good, noise] = counts.get((level, good, noise), 0) + 1
    p = accuracy_model(list(counts.items()), 5, 1, SubjectModel())
    assert p[4, 2, 1] > 0.9 and p[0, 1, 2] < 0.1 and abs(p[4, 1, 1] - p[4, 1, 2]) < 0.2


def test_held_out_truth(spark):
    docs, truth, labels = corpus()
    docs += [(900, None, None, None, None), (901, "", "", "", None), (902, " \n—", "x", None, None), (903, docs[5][1] * 300, None, None, None)]
    labels += [(5000, "law", "r1"), (None, "law", "r1"), (3, None, "r1"), (3, "cooking", None), labels[0]]
    mine = found(spark, docs, labels)
    truth |= {(903, s) for i, s in truth if i == 5}
    assert len(mine & truth) / len(truth) > 0.97 and len(mine - truth) < 0.03 * len(truth)


def test_empty_tables(spark):
    docs, _, labels = corpus(30)
    assert found(spark, [], labels) == set()
    assert found(spark, docs, labels, []) == set()
    assert isinstance(found(spark, docs, []), set)


def test_labels_of_all_raters_vote(spark, monkeypatch):
    docs, truth, _ = corpus()
    labels = [(i, s, f"r{i % 12}") for i, s in truth] + [(i, "none", f"r{i % 12}") for i in range(400)] + [(0, "law", f"few{k}") for k in range(5)] + [(0, "trade", "few0")]
    seen = []
    monkeypatch.setattr(module, "accuracy_model", lambda patterns, *rest: seen.extend(patterns) or accuracy_model(patterns, *rest))
    found(spark, docs, labels)
    assert sum(w for p, w in seen if any(v >= 2 for v in p[4:])) == len({x[:2] for x in labels if x[1] != "none"})
    assert {p[-1] for p, _ in seen} == {0, 1, 2, 3} and {len(p) for p, _ in seen} == {4 + 9}


def test_lexicon_keeps_every_word_that_qualifies(spark, caplog):
    docs, _, labels = corpus()
    texts = packed_words(spark.createDataFrame(docs, DOCS).selectExpr("doc_id", "text", "source", "title AS address"))
    given = clean_labels(spark.createDataFrame(labels, LABELS), sorted(WORDS))
    meaning = [(s, f"about {s}") for s in sorted(WORDS)]
    whole = fit_lexicon(texts, given, meaning, SubjectModel())
    expected = {(int(h), k) for k, s in enumerate(sorted(WORDS)) for h in word_hash(WORDS[s]).view(np.int64)}
    assert not caplog.records and expected <= whole.subject_of.items()
    assert fit_lexicon(texts, given, meaning, SubjectModel(most_terms=5)).subject_of == whole.subject_of
    assert "all are kept" in caplog.text
    fit_lexicon(texts, given, meaning, SubjectModel(most_rounds=1, settled=-1.0))
    assert "still changed" in caplog.text


def test_slices_are_packed_and_unpacked_whole():
    s = Sentences(["One two. Two three.\n\nFour", "", "one"])
    back = Slice.unpack(*Slice.pack(s))
    assert back.vocabulary[back.codes].tolist() == s.hashes.tolist() and back.sentence.tolist() == s.sentence.tolist()
    assert back.text.tolist() == [0, 0, 0, 2] and back.paragraph.tolist() == [0, 0, 1, 2]
    assert len(Slice.unpack(*Slice.pack(Sentences(["", ""]))).codes) == 0
