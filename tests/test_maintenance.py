import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.config import Prompt, Retrieval, load_config
from folioflow.operators import answering, maintenance
from folioflow.operators.embedding import HashedEmbedder, embed, embed_query
from folioflow.sources.library import load_documents, read_odt, read_rtf, scan_library
from folioflow.sources.store import current_version, read_index, save_index
from folioflow.streaming.ingest import DOCS, ingest

STATE = "path string, hash string, doc_type string, title string"


def test_change_log(spark):
    old = [("same", "h1", "plot", "S"), ("typed", "h2", "plot", "T"), ("edit", "h3", "plot", "E"), ("a/gone", "h4", "plot", "G"), ("b/gone", "h4", "plot", "G"), ("lost", None, None, None)]
    new = [("same", "h1", "plot", "S"), ("typed", "h2", "other", "T"), ("edit", "h9", "plot", "E"), ("c/new", "h4", "plot", "G"), ("fresh", "h7", "plot", "F"), ("blank", None, None, None)]
    log = maintenance.change_log(spark.createDataFrame(old, STATE), spark.createDataFrame(new, STATE))
    assert {tuple(r) for r in log.collect()} == {
        ("same", "same", "unchanged"), ("typed", "typed", "retyped"), ("edit", "edit", "updated"), ("c/new", "a/gone", "moved"),
        ("b/gone", "b/gone", "removed"), ("fresh", None, "added"), ("lost", "lost", "removed"), ("blank", None, "added"),
    }


def test_stale_counts(spark):
    schema = "path string, size bigint, mtime double"
    m = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0), ("d", 1, 1.0)], schema)
    f = spark.createDataFrame([("a", 1, 1.9), ("b", 2, 1.0), ("c", 1, 2.1), ("e", 1, 1.0)], schema)
    assert tuple(maintenance.stale_counts(m, f).first()) == (1, 2, 1)


def docx(*paragraphs):
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    body = "".join(f"<w:p><w:pPr><w:pStyle w:val='{s}'/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_scan_and_load(spark, tmp_path):
    root = tmp_path / "lib"
    files = {
        "characters/ada_lane.md": b"---\nx: 1\n---\nAda is tall.",
        "plot/out line.docx": docx(("Heading1", "Act"), ("Normal", "It ends.")),
        "plot/broken.docx": b"no zip",
        "plot/old.doc": b"x",
        "plot/.hidden.md": b"hidden",
        "README.md": b"read me",
        "drafts/latin.txt": "caf\xe9 “x”".encode("cp1252"),
        "drafts/empty.txt": b" \n",
    }
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    scanned = scan_library(spark, str(root))
    docs, skipped = load_documents(scanned)
    assert {(r.path, r.doc_type, r.title, r.text) for r in docs.collect()} == {
        ("characters/ada_lane.md", "character", "Ada Lane", "Ada is tall."),
        ("plot/out line.docx", "plot", "Out Line", "# Act\n\nIt ends."),
        ("drafts/latin.txt", "manuscript", "Latin", "café “x”"),
    }
    assert {r.path for r in skipped.collect()} == {"plot/broken.docx", "plot/old.doc", "drafts/empty.txt"}


def test_a_reader_of_ones_own(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/two.pair").write_text("one|two")
    (tmp_path / "lib/shout.txt").write_text("quiet")

    def pairs(data):
        return [(str(i), f"Part {i}", "", x) for i, x in enumerate(data.decode().split("|"))]

    own = {"pair": pairs, "txt": lambda data: data.decode().upper()}
    docs, skipped = load_documents(scan_library(spark, str(tmp_path / "lib"), readers=own), own)
    assert {(r.path, r.doc_id, r.title, r.text) for r in docs.collect()} == {
        ("two.pair", "0", "Part 0", "one"), ("two.pair", "1", "Part 1", "two"), ("shout.txt", "", "Shout", "QUIET"),
    }
    assert skipped.count() == 0


def test_store_versions(spark, tmp_path):
    root = str(tmp_path / "index")
    assert current_version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        read_index(spark, root, "passages")
    save_index(spark, root, {"passages": spark.range(3)}, chunks="c1")
    save_index(spark, root, {"passages": spark.range(5)}, chunks="c1")
    assert read_index(spark, root, "passages", chunks="c1").count() == 5
    with pytest.raises(ValueError):
        read_index(spark, root, "passages", chunks="c2")


def test_prompt_budget_skips_and_goes_on(spark):
    p = Prompt(max_context_chars=1000)
    rows = [("x", 1, 5000), ("x", 2, 10), ("y", 1, 300), ("y", 2, 800), ("y", 3, 400)]
    df = spark.createDataFrame(rows, "path string, n int, chars int")
    out = {r.path: (r.used, r.context_chars) for r in answering.prompt_budget(df, "path", ["n"], F.col("chars"), p).collect()}
    assert out == {"x": (1, 5120), "y": (2, 940)}
    messages = answering.build_messages("Q?", [{"path": "a", "text": "t" * 900, "doc_type": "plot"}, {"path": "b", "text": "u" * 900}], p=p)
    assert "[1]" in messages[-1]["content"] and "[2]" not in messages[-1]["content"]
    assert "No passages" in answering.build_messages("Q?", [])[-1]["content"]


def test_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "x" * 900) for i in range(1, 13)]
    kept = answering.history_window(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert sorted(r.turn for r in kept) == list(range(5, 13)) and max(len(r.text) for r in kept if r.role == "assistant") == 704
    talk = [(1, 1, "user", "Who is Ada Lane?"), (1, 3, "user", "Where does she live?"), (1, 5, "user", "Describe the harbour"), (1, 7, "user", "Did the old keeper of the northern lamp ever speak of it?")]
    out = answering.followup_text(spark.createDataFrame(talk, "conv_id int, turn int, role string, text string"))
    assert [r.search_text for r in out.orderBy("turn").collect()] == ["Who is Ada Lane?", "Who is Ada Lane? Where does she live?", "Describe the harbour", "Did the old keeper of the northern lamp ever speak of it?"]


def test_settings(tmp_path):
    (tmp_path / "a.toml").write_text("[retrieval]\nsemantic_weight = 2\nliteral_weight = 1\nnope = 1\nk = 'x'\n")
    config, warnings = load_config(tmp_path / "a.toml", tmp_path / "none.toml")
    assert config.retrieval.weights() == (2 / 3, 1 / 3) and len(warnings) == 2 and config.retrieval.k == 8
    (tmp_path / "b.toml").write_text("[retrieval")
    with pytest.raises(ValueError):
        load_config(tmp_path / "b.toml")
    with pytest.raises(ValueError):
        Retrieval(semantic_weight=-1).weights()


def test_settings_out_of_range(tmp_path):
    for line in ("[retrieval]\nk = 0", "[chunking]\noverlap_chars = 2000", "[library]\nmax_file_mb = 0", "[library.folders]\nx = 'poem'", "[prompt]\nnum_ctx = 5"):
        (tmp_path / "c.toml").write_text(line)
        with pytest.raises(ValueError, match="settings"):
            load_config(tmp_path / "c.toml")


def test_embeddings_are_stable_and_unit(spark):
    class Wrong(HashedEmbedder):
        def load(self):
            return lambda texts: [[1.0] * 3 for _ in texts]

    texts = ["a b", "a b c", "", None, "a b", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    made = {r.i: r.e for r in df.repartition(3).select("i", embed(F.col("t")).alias("e")).collect()}
    assert made[0] == made[4] == embed_query("a b") and not any(made[2]) and not any(made[3])
    assert all(abs(sum(x * x for x in made[i]) - 1) < 1e-6 for i in (0, 1, 5))
    with pytest.raises(Exception, match="not 64"):
        df.select(embed(F.col("t"), Wrong())).collect()


def test_many_files_of_one_content_are_paired_in_order(spark):
    old = spark.range(300).selectExpr("format_string('a/%05d', id) AS path", "'empty' AS hash", "'plot' AS doc_type", "'T' AS title")
    new = spark.range(200).selectExpr("format_string('b/%05d', id) AS path", "'empty' AS hash", "'plot' AS doc_type", "'T' AS title")
    log = maintenance.change_log(old, new).collect()
    assert {(r.path, r.old_path) for r in log if r.action == "moved"} == {(f"b/{i:05d}", f"a/{i:05d}") for i in range(200)}
    assert {r.path for r in log if r.action == "removed"} == {f"a/{i:05d}" for i in range(200, 300)}


def test_stream(spark, tmp_path):
    text = "# A\n\nThe harbour was cold.\n\n* * *\n\nThe lamp was out."
    rows = [(1, "p", "", "A", "", text, None), (1, "p", "", "A", "", text, None), (2, "q", "", "B", "", None, None), (3, "cast/all.md", "", "All", "", "Ada Lane\nAge: 1\n\nTom Reed\nAge: 2", None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "in"))
    query = ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_rtf():
    head = r"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Times;}}{\*\generator Some Word;}"
    body = r"Caf\'e9 \u8220?open\u8221?\par next\~one\_two\-three {\field{\*\fldinst HYPERLINK x}{\fldrslt seen}} \{x\}"
    assert read_rtf((head + body + "}").encode()) == "Caf\u00e9 \u201copen\u201d\nnext\u00a0one-twothree seen {x}"
    assert read_rtf(b"{\\rtf1 one\\\ntwo\\\r\nthree \\uc2\\u55357??\\u56842??}") == "one\ntwo\nthree \U0001f60a"


def test_rtf_code_pages():
    assert read_rtf(b"{\\rtf1\\ansicpg932 \\'93\\'fa\\'96\\'7b}") == "\u65e5\u672c"
    assert read_rtf(b"{\\rtf1\\ansicpg99999 caf\\'e9}") == "caf\u00e9"


def test_odt():
    t = "xmlns:t='urn:t'"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f"<d {t}><t:h t:outline-level='2'>Act</t:h><t:p>It<t:s/>ends<t:line-break/>here<t:s t:c='4'/>now</t:p></d>")
    assert read_odt(out.getvalue()) == "## Act\n\nIt ends\nhere    now"


def test_prompt_budget_of_long_groups(spark):
    p = Prompt(max_context_chars=1000, per_passage=10)
    rows = [(path, (i * 7919) % 500, (i * 37) % 400) for k, path in enumerate(["a", None, "b", "c"]) for i in range(k, 500)]
    expected = {}
    for path, _, n in sorted(rows, key=lambda r: r[1:]):
        used, total = expected.get(path, (0, 0))
        if not used or total + n + 10 <= p.budget:
            expected[path] = (used + 1, total + n + 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = answering.prompt_budget(spark.createDataFrame(rows, "path string, n int, chars int"), "path", ["n"], F.col("chars"), p)
        assert {r.path: (r.used, r.context_chars) for r in out.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    assert answering.prompt_budget(spark.createDataFrame([], "path string, n int, chars int"), "path", ["n"], F.col("chars"), p).count() == 0
