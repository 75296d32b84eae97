"""A versioned index of Parquet tables with an atomic pointer."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

#: Raised whenever tables of an older layout can't be read as they are.
FORMAT = 2


def _file_system(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def save_index(spark: SparkSession, root: str, tables: dict[str, DataFrame], **meta: str) -> str:
    """Write a new version (``postings`` sorted by term), then move the pointer to it; returns its name.

    Readers see the old version or the new one, never a mixture, and a failed write leaves the old.
    """
    version = f"v{time.time_ns()}"
    for name, df in tables.items():
        if name == "postings":
            df = df.repartitionByRange("term").sortWithinPartitions("term", "row_id")
        df.write.parquet(f"{root}/{version}/{name}")
    facts = [("format", str(FORMAT)), *((k, str(v)) for k, v in sorted(meta.items()))]
    spark.createDataFrame(facts, "key string, value string").coalesce(1).write.parquet(f"{root}/{version}/meta")
    fs, path = _file_system(spark, root)
    # The pointer is an empty file named after its version; the highest counts.
    fs.mkdirs(path(f"{root}/current"))
    fs.create(path(f"{root}/current/{version}")).close()
    return version


def current_version(spark: SparkSession, root: str) -> str | None:
    fs, path = _file_system(spark, root)
    pointers = path(f"{root}/current")
    return max((f.getPath().getName() for f in fs.listStatus(pointers)), default=None) if fs.exists(pointers) else None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of an index's own, if it is there."""
    fs, path_of = _file_system(spark, path)
    fs.delete(path_of(path), True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, path_of = _file_system(spark, path)
    return fs.exists(path_of(path))


def index_facts(spark: SparkSession, root: str) -> dict[str, str]:
    """The facts saved with the current version; an error if there is none."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no index in {root}")
    # A handful of rows.
    return {r.key: r.value for r in spark.read.parquet(f"{root}/{version}/meta").collect()}


def read_index(spark: SparkSession, root: str, name: str, **expected: str) -> DataFrame:
    """A table of the current version; an error if there is none or its facts aren't the expected ones."""
    meta = index_facts(spark, root)
    wrong = {k: meta.get(k) for k, v in {"format": FORMAT, **expected}.items() if meta.get(k) != str(v)}
    if wrong:
        raise ValueError(f"the index must be built again: {wrong}")
    return spark.read.parquet(f"{root}/{current_version(spark, root)}/{name}")
