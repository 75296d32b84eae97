"""New documents into passages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.config import Chunking
from folioflow.functions.text import doc_type_of
from folioflow.operators.chunking import chunk_documents
from folioflow.plans.runtime import importable

DOCS = "load_id bigint, path string, doc_id string, title string, section_prefix string, text string, loaded_at timestamp"


def stream_passages(docs: DataFrame, c: Chunking = Chunking(), lateness: str = "1 day") -> DataFrame:
    """Passages of a stream of loaded documents; a load that is delivered again within ``lateness`` counts once."""
    once = docs.withWatermark("loaded_at", lateness).dropDuplicatesWithinWatermark(["load_id"])
    return chunk_documents(once.withColumn("doc_type", doc_type_of(F.col("path"))), c)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, c: Chunking = Chunking()) -> StreamingQuery:
    """Append the passages of Parquet files that arrive in ``source`` to ``target``, then stop."""
    importable(spark)
    passages = stream_passages(spark.readStream.schema(DOCS).parquet(source), c)
    return passages.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
