"""Session set-up, table reading and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(app: str = "folioflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here relies on (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoints go once nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let the Python workers import this package from where the driver has it.

    A no-op where it is installed; on a cluster without it, ship it with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    importable(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one that the session names in ``spark.checkpoint.dir``.

    On a cluster it is shared by all executors. Only where it is unset, as in local tests, a temporary
    folder is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="folioflow-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the ``shared_folder``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder for tables that are written and read again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Steps after which rows are no longer where a scan has put them.
_MOVING = re.compile(r"\b(?:Join|Aggregate|Repartition\w*|RebalancePartitions|Sort|Window|Union|Distinct|Deduplicate\w*|\w*Limit)\b")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """``df``, of a scan, over at least as many partitions as there are task slots.

    Round-robin and only where the scan gives fewer partitions than slots, that is for inputs of a
    few files; a large input already has one partition for each split and is left as it is, as is whatever
    was joined, grouped or sorted, since its partitions are only known once it has run.
    """
    if _MOVING.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    slots = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "turn") -> DataFrame:
    """``df`` with the place, from 1, of each row among those of equal ``keys``, in order.

    A key that most rows share is spread like any other: rows are placed by ranges of key and order, numbered
    within their partition, and moved on by how many of the key the partitions before hold.
    """
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))
    held = placed.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))
    both = placed.withColumn("within", within).join(held.withColumn("before", before), [*keys, "part"])
    return both.withColumn(name, F.col("within") + F.col("before")).drop("part", "held", "within", "before")
