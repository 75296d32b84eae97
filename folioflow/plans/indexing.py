"""Building an index of a library, bringing it up to date by what changed, and searching it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.config import Config, Retrieval
from folioflow.functions.text import TOKENIZER, embed_text
from folioflow.operators import lexicon
from folioflow.operators.chunking import chunk_documents
from folioflow.operators.embedding import Embedder, HashedEmbedder, embed, embed_query
from folioflow.operators.maintenance import change_log, stale_files
from folioflow.operators.search import ask_indexed
from folioflow.plans.runtime import cut, importable
from folioflow.sources.library import Readers, load_documents, readable_files, scan_library
from folioflow.sources.store import current_version, exists, index_facts, read_index, remove, save_index

PASSAGES = "row_id bigint, path string, doc_id string, doc_type string, title string, section string, start_pos int, end_pos int, text string, embedding array<float>"
MANIFEST = "path string, hash string, size bigint, mtime double, doc_type string, title string"


def _previous(spark: SparkSession, index: str, rebuild: bool, **facts: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, passages) of the current version; empty ones where there is none that can be used."""
    if not rebuild and current_version(spark, index):
        try:
            return read_index(spark, index, "manifest", **facts), read_index(spark, index, "passages", **facts)
        except ValueError:
            pass
    return spark.createDataFrame([], MANIFEST), spark.createDataFrame([], PASSAGES)


def _embedded(spark: SparkSession, fresh: DataFrame, pending: str, model: Embedder, steps: int) -> DataFrame:
    """``fresh`` (row_id and columns of passages) with vectors, made and written step by step below ``pending``.

    What a run that failed has left there is not made again: a passage with the same id and the same
    text to embed is taken from it.
    """
    content = F.sha2(embed_text(F.col("title"), F.col("section"), F.col("text")), 256)
    fresh = cut(fresh.withColumn("content", content))
    before = exists(spark, pending)
    if before:
        done = spark.read.parquet(pending).select("row_id", "content")
        todo = fresh.join(done, ["row_id", "content"], "left_anti")
    else:
        todo = fresh
    for step in range(steps):
        part = todo.where(F.pmod(F.xxhash64("row_id"), F.lit(steps)) == step)
        vector = embed(embed_text(F.col("title"), F.col("section"), F.col("text")), model)
        part.withColumn("embedding", vector).write.mode("append").parquet(pending)
    made = spark.read.parquet(pending)
    # Passages of an earlier run may be of files that have changed again since.
    return (made.join(fresh.select("row_id", "content"), ["row_id", "content"], "left_semi").dropDuplicates(["row_id"]) if before else made).drop("content")


def update_index(
    spark: SparkSession, library: str, index: str, config: Config = Config(), rebuild: bool = False, dry_run: bool = False, model: Embedder = HashedEmbedder(),
    readers: Readers = {},
) -> tuple[DataFrame, DataFrame]:
    """Index what was added or changed under ``library``, keep the rest; returns (change log, skipped files).

    Passages of unchanged, retyped and moved files are taken over with their vectors, as long as the
    file's title, which is embedded with them, is still the same; only other files are cut and embedded.
    A file that can't be read any more, or is over the size limit, loses its passages
    and is listed as skipped. Other chunking settings, another model or another layout make everything new. The row ids are hashes of
    path and place, so they don't depend on what was indexed before. Nothing is written by a dry run. ``readers`` adds
    formats, by suffix.
    """
    importable(spark)
    facts = {"chunks": config.chunking.signature, "model": model.name, "dims": str(model.dims)}
    manifest, old = _previous(spark, index, rebuild, **facts)
    scanned = scan_library(spark, library, config.library, readers)
    docs, skipped = load_documents(scanned, readers)
    skipped = cut(skipped)
    state = cut(scanned.drop("content", "suffix", "reason", "hint").join(skipped.select("path"), "path", "left_anti"))
    log = cut(change_log(manifest, state))
    if dry_run:
        return log, skipped
    titles = manifest.select(F.col("path").alias("old_path"), F.col("title").alias("was"))
    kinds = state.select("path", F.col("doc_type").alias("kind"), "title")
    same = F.col("action").isin("unchanged", "retyped", "moved") & F.col("title").eqNullSafe(F.col("was"))
    fate = cut(log.where("action <> 'removed'").join(kinds, "path").join(titles, "old_path", "left").select("path", "old_path", "kind", same.alias("kept")))
    kept = fate.where("kept").select(F.col("path").alias("now"), F.col("old_path").alias("path"), "kind")
    reused = old.drop("row_id").join(kept, "path").drop("path", "doc_type").withColumnsRenamed({"now": "path", "kind": "doc_type"})
    work = docs.join(fate.where(~F.col("kept")).select("path"), "path", "left_semi")
    row_id = F.xxhash64("path", "doc_id", "start_pos", "end_pos", "section")
    pending = f"{index}/pending-{model.name}-{model.dims}"
    fresh = _embedded(spark, chunk_documents(work, config.chunking).drop("chunk_no").withColumn("row_id", row_id), pending, model, config.indexing.steps)
    passages = cut(reused.withColumn("row_id", row_id).unionByName(fresh))
    words = lexicon.with_tokens(passages.select("row_id", "title", "section", "text"))
    save_index(
        spark, index,
        {"passages": passages, "manifest": state, "postings": lexicon.postings(words), "corpus_stats": lexicon.corpus_stats(words)},
        tokenizer=str(TOKENIZER), **facts,
    )
    remove(spark, pending)
    return log, skipped


def stored_lexicon(spark: SparkSession, index: str) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of the current version; made from its passages where another tokeniser wrote them."""
    if index_facts(spark, index).get("tokenizer") == str(TOKENIZER):
        return read_index(spark, index, "postings"), read_index(spark, index, "corpus_stats")
    words = lexicon.with_tokens(read_index(spark, index, "passages").select("row_id", "title", "section", "text"))
    narrow = cut(lexicon.postings(words)), cut(lexicon.corpus_stats(words))
    return narrow


def search_library(
    spark: SparkSession, index: str, query: str, r: Retrieval = Retrieval(), k: int | None = None, doc_types: list[str] | None = None, model: Embedder | None = HashedEmbedder()
) -> DataFrame:
    """The best passages of an index for a question; by words alone if ``model`` is None.

    An index that another model made is an error.
    """
    facts = {"model": model.name, "dims": str(model.dims)} if model else {}
    passages = read_index(spark, index, "passages", **facts)
    vector = embed_query(query, model) if model else None
    return ask_indexed(passages, *stored_lexicon(spark, index), query, r, k, doc_types, vector)


def library_state(spark: SparkSession, library: str, index: str, config: Config = Config()) -> DataFrame:
    """``path, state`` of each file that is new, changed or missing since the index, by size and time only."""
    return stale_files(read_index(spark, index, "manifest"), readable_files(spark, library, config.library))
