import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm.splitting import cut_kinds, pieces, sections, split_oversized, split_text

RUN = re.compile(r"[^ \t\n\r]{1801,}")


def check(text, limit=1800, overlap=150, section=None):
    out = split_text(text, section, "", limit, overlap)
    done = 0
    for start, end, _, _ in out:
        assert 0 < end - start <= limit
        assert start <= done < end or (start, done) == (0, 0)
        assert done - start <= overlap
        done = end
    assert done == len(text)
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#\t。é́‍x", max_size=400), st.integers(8, 60), st.integers(0, 3))
def test_pieces_cover_exactly_and_keep_the_limit(text, limit, overlap):
    if text:
        out = check(text, limit, overlap)
        forced = any(level == "character" for *_, level in out)
        assert not forced or re.search(r"[^ \t\n\r]{%d,}" % (limit + 1), text)


def test_forced_only_in_long_runs():
    assert "character" not in {x[3] for x in check(("w" * 1800 + " ") * 3, section="")}
    assert "character" in {x[3] for x in check("a b " + "w" * 1801 + " c", section="")}
    assert "character" not in {x[3] for x in check("w" * 200 + " " + "v" * 1750 + " " + "u" * 1800, section="")}


def test_coarsest_boundary_first():
    text = "One. " * 100 + "\n\n" + "Two. " * 400
    first = pieces(text, 0, len(text))[0]
    assert text[first[0] : first[1]].endswith("\n\n") and first[2] == "paragraph"


def test_overlap_starts_at_a_sentence():
    text = "A short sentence stands here. " * 200
    out = pieces(text, 0, len(text))
    assert all(text[a:].startswith("A short") for a, _, _ in out) and out[1][0] < out[0][1]


def test_sections_carry_their_heading_path():
    text = "# A\n\nx\n\n## B\n\ny\n\nC\n===\n\nz\n"
    assert [label for _, _, label in sections(text, "P")] == ["P > A", "P > A > B", "P > C"]


def test_marks_stay_with_their_letters():
    text = "é" * 2000
    assert all(text[a] != "́" for a, *_ in pieces(text, 0, len(text)))


def test_query_form(spark):
    long = " ".join(random.Random(1).choices(["ab", "cde.", "f\n\n"], k=4000))
    rows = [(1, long, "S", 5), (1, long, "S", 5), (2, None, "S", 5), (3, "", None, 5), (4, "x" * 4000, None, 5), (5, "y " * 900, "T", 5), (6, "z" * 1_000_000, "", 5)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, section string, piece_no int")
    cut = split_oversized(df, "row_id", section="section")
    assert {(r.item_id, r.cut_kind) for r in cut_kinds(cut).collect()} == {(1, "natural"), (4, "forced"), (6, "forced")}
    for r in cut.collect():
        source = {1: long, 4: "x" * 4000, 6: "z" * 1_000_000}[r.item_id]
        assert r.text == source[r.start_pos : r.end_pos] and len(r.text) <= 1800
        assert r.section == {1: "S", 4: "", 6: ""}[r.item_id]
    assert split_oversized(df.limit(0), "row_id").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "row_id", overlap=900)


@pytest.mark.parametrize("tail", [1, 1640, 1700, 1800, 5000, 100_000])
def test_pieces_of_a_run_overlap(tail):
    for front, back in (("a b ", ""), ("", " c d"), ("One two. " * 300, " " + "v" * 1799)):
        out = check(front + "w" * (3600 + tail) + back, section="")
        after_cut = [b[0] - a[1] for a, b in zip(out, out[1:]) if a[3] == "character"]
        assert len(after_cut) >= 2 and set(after_cut) == {-150}
    assert check("a b " + "w" * 5000, section="")[1][:2] == (2, 1802)


def test_overlap_in_a_run_with_pauses_and_marks():
    for run in ("語" * 997 + "。", "e\u0301"):
        text = run * (20_000 // len(run))
        for a, b in zip(out := check(text, section=""), out[1:]):
            assert 148 <= a[1] - b[0] <= 150 and text[b[0]] != "\u0301"


def test_whole_words_go_before_overlap():
    out = check("a b " + "w" * 1799 + " " + "v" * 1750, section="")
    assert [x[:2] for x in out] == [(0, 4), (4, 1804), (1804, 3554)] and "character" not in {x[3] for x in out}


def test_repeated_rows_give_their_pieces_once(spark):
    rows = [(1, "word " * 500, "s"), (1, "word " * 500, "s"), (2, "other " * 500, "s"), (3, "word " * 500, "s"), (3, "word " * 501, "s"), (4, "short", "s"), (4, "short", "s")]
    df = spark.createDataFrame(rows, "k bigint, text string, part string")
    pieces = split_oversized(df, "k", section="part", once=True)
    spans = [tuple(r) for r in pieces.select("item_id", "piece_no", "start_pos", "end_pos").collect()]
    assert len(spans) == len(set(spans)) + 1 and {s[0] for s in spans} == {1, 2, 3}
    assert sorted(set(spans)) == sorted({tuple(r) for r in split_oversized(df, "k", section="part").select("item_id", "piece_no", "start_pos", "end_pos").collect()})
