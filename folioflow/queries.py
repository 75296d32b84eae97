"""Registered queries of the core, each over whole tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.config import Chunking, Prompt, Retrieval
from folioflow.functions import text as T
from folioflow.operators import answering, chunking, embedding, lexicon, literal, maintenance
from folioflow.operators import search as S
from folioflow.operators.snapshots import normal_path, snapshot_changes
from folioflow.plans.indexing import stored_lexicon
from folioflow.plans.runtime import cut, scratch, spread, table
from folioflow.sources.store import read_index, remove, save_index
from folioflow.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]

#: What the ranking queries ask for.
TERMS = ["harbour", "lantern", "court", "storm"]
NAMES = ["lantern", "zemiholt", "harbour"]
PHRASE = "the talk in"
NEEDLE = "The Talk"
PLAN = S.QueryPlan(TERMS, NAMES, {"other": -0.01, "character": 0.07}, [PHRASE])
#: A question in words, and settings that hear where and who it asks for.
QUESTION = 'Where did the "talk in" the Harbour stop the storm?'
ASKED = Retrieval(intent_cues={"location": ("where", "harbour"), "character": ("who is",)})


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as passages: the source stands for the file."""
    none = F.lit("")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("path"), F.coalesce("doc_type", F.lit("other")).alias("doc_type"),
        F.coalesce("title", none).alias("title"), none.alias("section"), F.coalesce("text", none).alias("text"),
    )


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings there are of the corpus, by row."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """The passages without their delivery times."""
    return spread(table(spark, sf, "passages").drop("indexed_at"))


def tokenised(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.with_tokens(spread(corpus(spark, sf)))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(table(spark, sf, "manifest")).select("snapshot_no", "path", "change_kind")


def clean_text_len(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.length(T.clean_text(F.col("text"))).alias("chars"))


def collapse_preview(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.collapse(F.col("text"), 80).alias("preview"))


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("hash"))


def doc_type_from_path(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").select("path", T.doc_type_of(F.col("path")).alias("kind")).distinct()


def pretty_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").select("path", T.pretty_title(F.col("path")).alias("pretty")).distinct()


def citations(spark: SparkSession, sf: str) -> DataFrame:
    return passages(spark, sf).select("row_id", T.citation(F.col("path"), F.col("section"), F.col("title")).alias("citation")).distinct()


def embed_headers(spark: SparkSession, sf: str) -> DataFrame:
    return passages(spark, sf).select("row_id", F.length(T.embed_text(F.col("title"), F.col("section"), F.col("text"))).alias("chars")).distinct()


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokenised(spark, sf).select("row_id", "dl")


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.corpus_stats(tokenised(spark, sf)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def doc_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.term_stats(tokenised(spark, sf))


def postings_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    return doc_frequency(spark, sf).orderBy(F.desc("df"), "term").limit(50)


def rare_terms(spark: SparkSession, sf: str) -> DataFrame:
    t = tokenised(spark, sf)
    stats = lexicon.term_stats(t).crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("n"))))
    return lexicon.rare_terms(stats, F.col("n")).select("term", "df")


def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = lexicon.bm25_scan(corpus(spark, sf), TERMS)
    return scored.where("literal > 0").select("row_id", F.round("literal", 6).alias("literal"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    scored = lexicon.bm25_scan(corpus(spark, sf), TERMS)
    return scored.orderBy(F.desc(F.round("literal", 6)), "row_id").limit(20).select("row_id", F.round("literal", 6).alias("literal"))


def bm25_from_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores by way of the inverted index."""
    t = tokenised(spark, sf)
    scores = lexicon.bm25_indexed(lexicon.postings(t), lexicon.corpus_stats(t), TERMS)
    return scores.select("row_id", F.round("literal", 6).alias("literal"))


def presence_fraction(spark: SparkSession, sf: str) -> DataFrame:
    counted = lexicon.counted_terms(corpus(spark, sf), NAMES)
    return counted.select("row_id", F.round(lexicon.presence(NAMES, NAMES), 6).alias("held")).where("held > 0")


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = query_vector(spark, sf)
    scored = table(spark, sf, "embeddings").select("vec_id", F.round(S.cosine(F.col("embedding"), q), 6).alias("cos"))
    return scored.orderBy(F.desc("cos"), "vec_id").limit(20)


def minmax_normalised(spark: SparkSession, sf: str) -> DataFrame:
    q = query_vector(spark, sf)
    scored = table(spark, sf, "embeddings").select("vec_id", S.cosine(F.col("embedding"), q).alias("cos"))
    bounds = scored.agg(F.min("cos").alias("low"), F.max("cos").alias("high"))
    value = S.normalised(F.col("cos"), F.col("low"), F.col("high"))
    return scored.crossJoin(F.broadcast(bounds)).select("vec_id", F.round(value, 6).alias("scaled"))


def _hits(df: DataFrame, *more) -> DataFrame:
    return df.select("row_id", "path", "tier", F.round("score", 6).alias("score"), "phrase_hit", *more)


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    plan = S.QueryPlan(PLAN.terms, PLAN.names, PLAN.bonuses, PLAN.phrases, query_vector(spark, sf))
    return _hits(S.search(corpus(spark, sf), plan, vectors=embeddings(spark, sf)))


def hybrid_type_filtered(spark: SparkSession, sf: str) -> DataFrame:
    plan = S.QueryPlan(PLAN.terms, PLAN.names, PLAN.bonuses, PLAN.phrases, query_vector(spark, sf))
    return _hits(S.search(corpus(spark, sf), plan, doc_types=["history", "culture"], vectors=embeddings(spark, sf)))


def search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same ranking as ``hybrid_topk`` by way of an inverted index."""
    t = tokenised(spark, sf).select("row_id", "tokens", "dl")
    plan = S.QueryPlan(PLAN.terms, PLAN.names, PLAN.bonuses, PLAN.phrases, query_vector(spark, sf))
    return _hits(S.search_indexed(corpus(spark, sf), lexicon.postings(t), lexicon.corpus_stats(t), plan, vectors=embeddings(spark, sf)))


def search_stored(spark: SparkSession, sf: str) -> DataFrame:
    """A ranking by words alone through an index that is saved, pointed to and read again."""
    root = scratch(spark, "index")
    t = tokenised(spark, sf).select("row_id", "tokens", "dl")
    save_index(spark, root, {"passages": corpus(spark, sf), "postings": lexicon.postings(t), "corpus_stats": lexicon.corpus_stats(t)}, tokenizer=str(T.TOKENIZER))
    hits = _hits(S.search_indexed(read_index(spark, root, "passages"), *stored_lexicon(spark, root), PLAN))
    # A few rows, so the index can go.
    rows = spark.createDataFrame(hits.collect(), hits.schema)
    remove(spark, root)
    return rows


def literal_only_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(S.search(corpus(spark, sf), S.QueryPlan(TERMS)))


def phrase_boost_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(S.search(corpus(spark, sf), S.QueryPlan(TERMS, [], {}, [PHRASE])))


def intent_nudge_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(S.search(corpus(spark, sf), S.QueryPlan(TERMS, [], PLAN.bonuses)))


def file_cap_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(S.search(corpus(spark, sf), S.QueryPlan(TERMS), Retrieval(max_per_file=1), k=40))


def planned_search(spark: SparkSession, sf: str) -> DataFrame:
    """A question from words to hits, with names, intent and phrases worked out from it."""
    hits = S.ask(corpus(spark, sf), QUESTION, ASKED)
    return _hits(hits, F.array_join("names_matched", " ").alias("names"))


def find_literal(spark: SparkSession, sf: str) -> DataFrame:
    return literal.find_literal(passages(spark, sf), NEEDLE)


def find_files(spark: SparkSession, sf: str) -> DataFrame:
    return literal.find_files(literal.find_literal(passages(spark, sf), NEEDLE))


def find_typed(spark: SparkSession, sf: str) -> DataFrame:
    return literal.find_literal(passages(spark, sf), "the", ["history", "plot"]).groupBy("row_id").agg(F.count(F.lit(1)).alias("places"))


def _states(spark: SparkSession, sf: str, *numbers: int) -> list[DataFrame]:
    """Snapshots of the manifest, counted back from the last, each by its last delivery and with a record per path."""
    m = table(spark, sf, "manifest").withColumn("path", normal_path(F.col("path"))).withColumn("hash", F.lower(F.trim("hash")))
    # Two rows: the numbers of the last two snapshots and of their last deliveries.
    last = m.groupBy("snapshot_no").agg(F.max("delivery_no").alias("delivery_no")).orderBy(F.desc("snapshot_no")).limit(2).collect()
    out = []
    for number in numbers:
        at = last[min(number, len(last) - 1)] if last else None
        rows = m.where((F.col("snapshot_no") == at[0]) & (F.col("delivery_no") == at[1])) if at else m
        out.append(maintenance.one_per_path(rows.select("path", "hash", "size", "mtime", "doc_type", "title")))
    return out


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.change_log(*_states(spark, sf, 1, 0))


def moved_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files that moved between any snapshot of the manifest and the next."""
    m = table(spark, sf, "manifest").withColumn("path", normal_path(F.col("path"))).withColumn("hash", F.lower(F.trim("hash")))
    # One row for each snapshot.
    last = m.groupBy("snapshot_no").agg(F.max("delivery_no").alias("delivery_no")).orderBy("snapshot_no").collect()
    steps = spark.createDataFrame([(a[0], a[1], b[0] if b else None) for a, b in zip(last, [*last[1:], None])], "snapshot_no int, delivery_no int, next int")
    rows = m.join(F.broadcast(steps), ["snapshot_no", "delivery_no"])
    kept = ("path", "hash", "mtime", "size", "doc_type", "title")
    after = maintenance.one_per_path(rows.select("snapshot_no", *kept), ("snapshot_no",))
    before = maintenance.one_per_path(rows.where("next is not null").select(F.col("next").alias("snapshot_no"), *kept), ("snapshot_no",))
    return maintenance.change_log(before, after, ("snapshot_no",)).where("action = 'moved'").select("snapshot_no", "path", "old_path")


def moved_folder(spark: SparkSession, sf: str) -> DataFrame:
    """The moves found where all files in folders of one name stand in folders of another, by content alone."""
    (now,) = _states(spark, sf, 0)
    renamed = maintenance.one_per_path(now.withColumn("path", F.replace("path", F.lit("/drafts/"), F.lit("/chapters/"))))
    return maintenance.change_log(now, renamed).where("action = 'moved'").select("path", "old_path")


def stale_counts(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "files").select("path", "hash", "size", "mtime")
    return maintenance.stale_counts(*_states(spark, sf, 1), maintenance.one_per_path(files))


def status_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.status_by_type(passages(spark, sf))


def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return passages(spark, sf).groupBy("path").agg(F.count_distinct("row_id").alias("chunks"))


def orphan_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of files that are there no longer."""
    return passages(spark, sf).join(table(spark, sf, "files").select("path"), "path", "left_anti").select("row_id", "path").distinct()


def prompt_budget(spark: SparkSession, sf: str) -> DataFrame:
    """How many of each file's passages fit a prompt, in their order."""
    rows = passages(spark, sf).groupBy("row_id", "path").agg(F.max(F.length("text")).alias("chars")).where("chars is not null")
    return answering.prompt_budget(rows, "path", ["row_id"], F.col("chars"), Prompt())


def prompt_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Each file's passages as they stand in a prompt of it; only those that fit meet their texts again."""
    p = passages(spark, sf).where("text is not null")
    sizes = p.groupBy("row_id", "path").agg(F.max(F.length("text")).alias("chars"))
    taken = answering.prompt_passages(sizes, "path", ["row_id"], F.col("chars"), Prompt())
    columns = ["doc_type", "section", "title", "text"]
    told = p.join(taken.select("row_id", "path"), ["row_id", "path"], "left_semi").groupBy("row_id", "path").agg(*[F.max(c).alias(c) for c in columns])
    block = answering.prompt_block(F.col("prompt_n"), F.col("doc_type"), F.col("path"), F.col("section"), F.col("title"), F.col("text"))
    return taken.join(told, ["row_id", "path"]).select("row_id", "path", "prompt_n", F.sha2(block, 256).alias("block"))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "docs")).withColumn("doc_type", T.doc_type_of(F.col("path")))


def chunk_passages(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(_docs(spark, sf), Chunking()).groupBy("path", "doc_id", "section", "start_pos", "end_pos").agg(F.max(F.length("text")).alias("chars"))


def stream_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The same passages from a stream of the documents, written and read again."""
    out = scratch(spark, "passages")
    # A pattern, as the table may be one file or a folder of files.
    ingest(spark, f"{sf}/docs.parque[t]", f"{out}/table", f"{out}/state").awaitTermination()
    spans = cut(spark.read.parquet(f"{out}/table").groupBy("path", "doc_id", "section", "start_pos", "end_pos").agg(F.max(F.length("text")).alias("chars")))
    remove(spark, out)
    return spans


def chunk_spans_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document how many passages it has, and how many of them are not the slice of it that they say."""
    docs = _docs(spark, sf).where("text is not null").select("path", "doc_id", "text").distinct()
    # A document is told by its text too, as one place may have been loaded with several.
    named = docs.withColumn("doc_id", F.concat_ws("#", F.coalesce("doc_id", F.lit("")), F.sha2("text", 256)))
    passages_of = chunking.chunk_documents(named.withColumns({"doc_type": T.doc_type_of(F.col("path")), "title": F.lit(""), "section_prefix": F.lit("")}), Chunking())
    held = passages_of.select("path", "doc_id", "start_pos", "end_pos", F.col("text").alias("passage")).join(named.withColumn("path", F.coalesce("path", F.lit(""))), ["path", "doc_id"])
    slice_ = F.substring(F.col("text"), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    per = held.groupBy("path", F.sha2("text", 256).alias("doc")).agg(F.count(F.lit(1)).alias("passages"), F.sum((slice_ != F.col("passage")).cast("bigint")).alias("wrong"))
    return per.groupBy("path", "doc").agg(F.sum(F.when(F.col("passages") > 0, F.col("wrong"))).alias("wrong"))


def embedded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The length of each document's hashed embedding: one, or zero for a text without words."""
    e = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", embedding.embed(F.col("text")).alias("e"))
    norm = F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return e.select("doc_id", F.round(F.sqrt(norm), 4).alias("norm"))


def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The length of each vector that is there after it was scaled: one, or zero for a zero vector."""
    v = table(spark, sf, "vectors").where("embedding is not null").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    norm = F.aggregate(embedding.unit(F.col("embedding")), F.lit(0.0), lambda s, x: s + x * x)
    return v.select("row_id", F.round(F.sqrt(norm), 6).alias("norm")).distinct()


def found_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Each place of the needle with the words round it."""
    rows = passages(spark, sf)
    found = literal.find_literal(rows, NEEDLE)
    return literal.with_snippets(found, rows, len(NEEDLE), 60).select("row_id", "local", "shown")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages as the messages of conversations, one for each document, by turns of a user and an assistant."""
    p = table(spark, sf, "passages").where("text is not null").groupBy("row_id", "path", "doc_id").agg(F.max("text").alias("text"))
    return p.select(
        F.concat_ws("#", "path", "doc_id").alias("conv_id"), F.col("row_id").alias("turn"), F.when(F.col("row_id") % 2 == 0, "user").otherwise("assistant").alias("role"), "text"
    )


def chat_history_window(spark: SparkSession, sf: str) -> DataFrame:
    return answering.history_window(messages(spark, sf)).select("conv_id", "turn", "role", F.sha2("text", 256).alias("said"))


def followup_search_text(spark: SparkSession, sf: str) -> DataFrame:
    return answering.followup_text(messages(spark, sf)).select("conv_id", "turn", F.sha2("search_text", 256).alias("asked"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p4_found, clean_text_len, collapse_preview, content_hash, doc_type_from_path, pretty_titles, citations, embed_headers,
        token_counts, corpus_stats, doc_frequency, postings_top_terms, rare_terms, bm25_scores, bm25_topk, bm25_from_postings,
        presence_fraction, cosine_topk, minmax_normalised, hybrid_topk, hybrid_type_filtered, search_indexed, search_stored, literal_only_topk, phrase_boost_topk,
        intent_nudge_topk, file_cap_topk, planned_search, find_literal, find_files, find_typed, found_snippets, change_log, moved_files, moved_folder, stale_counts,
        status_by_type, chunk_counts, orphan_passages, prompt_budget, prompt_blocks, chunk_passages, stream_passages, chunk_spans_valid, embedded_texts, unit_vectors,
        chat_history_window, followup_search_text,
    )
}
