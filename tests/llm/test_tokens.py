import base64
import os

import pytest

from folioflow.llm.tokens import SPLIT, VOCABULARY, PairIndexEncoder, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, " ", " \n\t", "aaaaaaa", "abababab" * 50, "don't <|endoftext|> stop", "Žluťoučký 看板には👩‍🚀", "x" * 5000, "The talk in Vorëhaven was all court."]


def test_equals_a_public_encoder(spark, reference):
    rows = [(n, t, 1) for n, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1)]
    out = encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids int")).collect()
    assert sorted((r[0], r[1]) for r in out) == sorted((n, reference.encode_ordinary(t or "")) for n, t, _ in rows)


def test_whole_table(spark, reference):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    for row in encode_corpus(documents).collect():
        assert row.ids == reference.encode_ordinary(texts[row.doc_id] or "")
        assert reference.decode(row.ids) == (texts[row.doc_id] or "")


def test_pairs_that_overlap():
    encoder = PairIndexEncoder(VOCABULARY)
    assert encoder.merge(["aaaa", "a"])[1] == (encoder.ranks[b"a"],)


def test_empty_table(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
