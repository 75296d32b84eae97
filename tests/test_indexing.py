from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from folioflow import cli
from folioflow.config import Config, Indexing, Library
from folioflow.functions.text import embed_text
from folioflow.operators.embedding import HashedEmbedder, embed_query
from folioflow.plans import indexing
from folioflow.plans.indexing import search_library, update_index
from folioflow.sources.library import load_documents, scan_library
from folioflow.sources.store import read_index, save_index


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def actions(log):
    return {(r.path, r.action) for r in log.collect()}


def test_index_follows_the_library(spark, tmp_path):
    lib, index = tmp_path / "lib", str(tmp_path / "index")
    write(lib, **{"characters__ada.md": "Ada is tall.", "plot__end.md": "# End\n\nThe lamp goes out.", "drafts__one.md": "The harbour was cold."})
    log, skipped = update_index(spark, str(lib), index)
    assert {a for _, a in actions(log)} == {"added"} and skipped.count() == 0
    before = {r.text: r for r in read_index(spark, index, "passages").collect()}
    assert len(before) == 3 and all(len(r.embedding) == 64 for r in before.values())

    write(lib, **{"plot__end.md": "# End\n\nThe lamp stays lit.", "drafts__broken.docx": "no zip"})
    (lib / "locations").mkdir()
    (lib / "drafts/one.md").rename(lib / "locations/one.md")
    (lib / "characters/ada.md").unlink()
    log, skipped = update_index(spark, str(lib), index, dry_run=True)
    expected = {("plot/end.md", "updated"), ("locations/one.md", "moved"), ("characters/ada.md", "removed")}
    assert actions(log) == expected and [r.path for r in skipped.collect()] == ["drafts/broken.docx"]
    assert read_index(spark, index, "passages").count() == 3
    update_index(spark, str(lib), index)
    after = {r.text: r for r in read_index(spark, index, "passages").collect()}
    assert set(after) == {"The lamp stays lit.", "The harbour was cold."}
    moved = after["The harbour was cold."]
    assert (moved.path, moved.doc_type, moved.embedding) == ("locations/one.md", "location", before["The harbour was cold."].embedding)
    assert fresh_vectors(spark, index)
    log, _ = update_index(spark, str(lib), index)
    assert {a for _, a in actions(log)} == {"unchanged"}
    assert read_index(spark, index, "postings").where("term = 'harbour'").count() == 1

    at = ["--config", str(tmp_path / "none.toml"), "--index", index]
    assert cli.main([*at, "find", "HARBOUR"])[0]["path"] == "locations/one.md"
    assert cli.main([*at, "ask", "where is the harbour", "-k", "1"])[0]["where"] == "locations/one.md (One)"
    assert cli.main([*at, "find", "was", "-C", "9"])[0]["shown"] == "harbour >>was<< cold."
    assert {r["doc_type"] for r in cli.main([*at, "status"])} == {"location", "plot"}
    write(lib, **{"plot__new.md": "More.", "plot__unread.png": "p", "README.md": "x"})
    (lib / "plot/end.md").unlink()
    stale = {(r["path"], r["state"]) for r in cli.main([*at, "status", str(lib)]) if "state" in r}
    assert stale == {("plot/new.md", "added"), ("plot/end.md", "missing"), ("drafts/broken.docx", "added")}


def fresh_vectors(spark, index):
    """Whether every stored vector is that of its passage as it is named now."""
    rows = read_index(spark, index, "passages").withColumn("e", embed_text(F.col("title"), F.col("section"), F.col("text"))).collect()
    return bool(rows) and all(list(r.embedding) == embed_query(r.e) for r in rows)


def test_a_renamed_file_is_embedded_under_its_new_title(spark, tmp_path):
    lib, index = tmp_path / "lib", str(tmp_path / "index")
    write(lib, **{"plot__harbour_lights.md": "The lamp goes out.", "plot__other.md": "Rain."})
    update_index(spark, str(lib), index)
    (lib / "plot/harbour_lights.md").rename(lib / "plot/storm_court.md")
    log, _ = update_index(spark, str(lib), index)
    assert actions(log) == {("plot/storm_court.md", "moved"), ("plot/other.md", "unchanged")}
    assert {r.title for r in read_index(spark, index, "passages").collect()} == {"Storm Court", "Other"} and fresh_vectors(spark, index)


def test_another_model_builds_anew_and_is_told_apart(spark, tmp_path):
    lib, index = tmp_path / "lib", str(tmp_path / "index")
    write(lib, **{"plot__end.md": "The lamp goes out."})
    update_index(spark, str(lib), index)
    with pytest.raises(ValueError, match="built again"):
        search_library(spark, index, "lamp", model=HashedEmbedder(dims=32))
    log, _ = update_index(spark, str(lib), index, model=HashedEmbedder(dims=32))
    assert {a for _, a in actions(log)} == {"added"} and len(read_index(spark, index, "passages").first().embedding) == 32
    assert search_library(spark, index, "lamp", model=HashedEmbedder(dims=32)).first().literal > 0
    assert search_library(spark, index, "lamp", model=None).first().literal > 0


def test_postings_of_another_tokeniser_are_made_again(spark, tmp_path):
    lib, index = tmp_path / "lib", str(tmp_path / "index")
    write(lib, **{"plot__end.md": "The lamp goes out.", "plot__rain.md": "Rain."})
    update_index(spark, str(lib), index)
    tables = {x: read_index(spark, index, x) for x in ("passages", "manifest", "corpus_stats")}
    wrong = read_index(spark, index, "postings").withColumn("term", F.lit("nothing"))
    save_index(spark, index, {**tables, "postings": wrong}, chunks=Config().chunking.signature, model="hashed-2", dims="64", tokenizer="1")
    assert search_library(spark, index, "lamp").first().literal > 0


def test_a_failed_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    lib, index = tmp_path / "lib", str(tmp_path / "index")
    write(lib, **{f"plot__{i}.md": f"Text number {i} of the plot." for i in range(12)})
    config = Config(indexing=Indexing(steps=2))

    def fail(*_, **__):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(indexing, "save_index", fail)
        with pytest.raises(OSError):
            update_index(spark, str(lib), index, config)
    write(lib, **{"plot__3.md": "Another text for the third.", "plot__new.md": "A new one."})
    asked = spark.sparkContext.accumulator(0)

    class Counting(HashedEmbedder):
        def load(self):
            def vectors(texts):
                asked.add(len(texts))
                return self.vectors(texts)

            return vectors

    update_index(spark, str(lib), index, config, model=Counting())
    assert asked.value == 2
    assert read_index(spark, index, "passages").count() == 13 and fresh_vectors(spark, index)
    assert not list(tmp_path.glob("index/pending*"))


SCRIVX = """<ScrivenerProject><Binder>
<BinderItem UUID="D" Type="DraftFolder"><Title>Draft</Title><Children>
<BinderItem UUID="A1" Type="Text"><Title>The Crossing</Title></BinderItem><BinderItem ID="7" Type="Text"><Title>Old</Title></BinderItem>
</Children></BinderItem>
<BinderItem UUID="T" Type="TrashFolder"><Title>Trash</Title><Children><BinderItem UUID="B2" Type="Text"><Title>Gone</Title></BinderItem></Children></BinderItem>
</Binder></ScrivenerProject>"""


def awkward(lib):
    write(lib, **{"notes/_draft.md": "An underscore.", "_plan/a+b %20é.md": "A folder.", "notes/.secret.md": "A dot.", ".trash/x.md": "A dot folder.", "notes/big.txt": "b" * 3000, "notes/big.png": "p" * 3000, "notes/empty.rtfd/pic.png": "p"})
    write(lib, **{"notes/walk.rtfd/TXT.rtf": r"{\rtf1 A walk.}", "notes/walk.rtfd/pic.png": "p" * 100, "book/my_novel.scriv/my_novel.scrivx": SCRIVX})
    for place, text in {"Data/A1/content.rtf": "They cross.", "Docs/7.rtf": "They wait.", "Data/B2/content.rtf": "Thrown away."}.items():
        write(lib, **{f"book/my_novel.scriv/Files/{place}": rf"{{\rtf1 {text}}}"})


def test_scan_names_sizes_and_bundles(spark, tmp_path):
    awkward(tmp_path / "lib")
    small = Library(max_file_mb=2500 / 2**20)
    docs, skipped = load_documents(scan_library(spark, str(tmp_path / "lib"), small))
    shown = {
        ("notes/_draft.md", "", "Draft", "", "An underscore."),
        ("_plan/a+b %20é.md", "", "A+b %20é", "", "A folder."),
        ("notes/walk.rtfd", "", "Walk", "", " A walk."),
        ("book/my_novel.scriv", "A1", "The Crossing", "Draft", "# The Crossing\n\nThey cross."),
        ("book/my_novel.scriv", "7", "Old", "Draft", "# Old\n\nThey wait."),
    }
    columns = ["path", "doc_id", "title", "section_prefix", "text"]
    assert {(*r[:4], r[4].strip()) for r in docs.select(columns).collect()} == {(*x[:4], x[4].strip()) for x in shown}
    assert {r.path: bool(r.reason and r.hint) for r in skipped.collect()} == {"notes/big.txt": True, "notes/empty.rtfd": True}
    docs, _ = load_documents(scan_library(spark, str(tmp_path / "lib"), replace(small, skip_hidden=False)))
    assert {r.path for r in docs.collect()} == {x[0] for x in shown} | {"notes/.secret.md", ".trash/x.md"}


def test_index_of_bundles_and_oversized_files(spark, tmp_path):
    lib, index = tmp_path / "lib", str(tmp_path / "index")
    awkward(lib)
    update_index(spark, str(lib), index)
    assert read_index(spark, index, "passages").where("path = 'notes/big.txt'").count() > 0
    (lib / "book/my_novel.scriv").rename(lib / "book/renamed.scriv")
    log, skipped = update_index(spark, str(lib), index, Config(library=Library(max_file_mb=2500 / 2**20)))
    assert {(r.path, r.action) for r in log.where("action <> 'unchanged'").collect()} == {("book/renamed.scriv", "moved"), ("notes/big.txt", "removed")}
    assert {r.path for r in skipped.collect()} == {"notes/big.txt", "notes/empty.rtfd"}
    after = read_index(spark, index, "passages")
    assert {(r.doc_id, r.title) for r in after.where("path = 'book/renamed.scriv'").collect()} == {("A1", "The Crossing"), ("7", "Old")}
    assert after.where("path = 'notes/big.txt'").count() == 0
