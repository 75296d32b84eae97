"""Which files an index has to add, read again, move or drop, and how stale it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.plans.runtime import cut, numbered


def one_per_path(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The record of highest mtime of each path (null lowest, ties by hash), by a combining aggregate."""
    keys = [*by, "path"]
    rest = [c for c in records.columns if c not in (*keys, "mtime", "hash")]
    best = F.max(F.struct(F.col("mtime").isNotNull().alias("known"), "mtime", "hash", *rest)).alias("r")
    return records.where("path is not null").groupBy(*keys).agg(best).select(*keys, *[F.col(f"r.{c}").alias(c) for c in records.columns if c not in keys])


def change_log(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``path, old_path, action`` between two states of a library (path, hash, doc_type, title; unique paths).

    ``unchanged``, ``retyped`` (same content, other kind or title), ``updated`` (other content),
    ``moved`` (a path that is gone passes its content on to a new one: the n-th gone path of a hash, in
    order of path, to the n-th new one), ``added``, ``removed``. Null hashes are equal to nothing. With
    ``by``, columns of both sides, as many comparisons as these have values, each for itself.

    One shuffle by path finds what both sides have. Only hashes that a gone and a new path have go on
    to the pairing, where a hash that most of them share, as that of empty files, is numbered in ranges.
    """
    keys = [*by, "path"]
    o = old.select(*keys, F.col("hash").alias("oh"), F.col("doc_type").alias("ot"), F.col("title").alias("otitle"), F.lit(True).alias("was"))
    n = new.select(*keys, F.col("hash").alias("nh"), F.col("doc_type").alias("nt"), F.col("title").alias("ntitle"), F.lit(True).alias("isnow"))
    both = o.join(n, keys, "full")
    same = F.coalesce(F.col("oh") == F.col("nh"), F.lit(False))
    alike = F.col("ot").eqNullSafe(F.col("nt")) & F.col("otitle").eqNullSafe(F.col("ntitle"))
    action = F.when(F.col("isnow").isNull(), "removed").when(F.col("was").isNull(), "added").when(~same, "updated").when(alike, "unchanged").otherwise("retyped")
    # Read three times, with a row for each path.
    acted = cut(both.select(*keys, F.coalesce("nh", "oh").alias("hash"), action.alias("action")))
    single = acted.where("action in ('removed', 'added') and hash is not null")
    side = {x: F.max((F.col("action") == x).cast("int")).alias(x) for x in ("removed", "added")}
    shared = single.groupBy(*by, "hash").agg(*side.values()).where("removed = 1 and added = 1").select(*by, "hash")
    turns = numbered(single.join(shared, [*by, "hash"], "left_semi"), [*by, "hash", "action"], ["path"])
    donors = turns.where("action = 'removed'").select(*by, "hash", "turn", F.col("path").alias("from"))
    moves = turns.where("action = 'added'").join(donors, [*by, "hash", "turn"]).select(*by, "path", "from")
    # A path that was passed on is no removal of its own.
    marks = moves.withColumn("passed", F.lit(False)).unionByName(moves.select(*by, F.col("from").alias("path"), F.lit(None).cast("string").alias("from"), F.lit(True).alias("passed")))
    told = acted.join(marks, keys, "left").where(~F.coalesce("passed", F.lit(False)))
    old_path = F.when(F.col("action") == "added", F.col("from")).otherwise(F.col("path"))
    return told.select(*keys, old_path.alias("old_path"), F.when(F.col("from").isNotNull(), "moved").otherwise(F.col("action")).alias("action"))


def _compared(manifest: DataFrame, files: DataFrame, tolerance: float) -> tuple[DataFrame, dict[str, Column]]:
    m = manifest.select("path", F.col("size").alias("ms"), F.col("mtime").alias("mm"), F.lit(1).alias("m"))
    f = files.select("path", F.col("size").alias("fs"), F.col("mtime").alias("fm"), F.lit(1).alias("f"))
    differs = ~F.col("ms").eqNullSafe(F.col("fs")) | F.coalesce(F.col("fm") > F.col("mm") + tolerance, F.lit(False))
    states = {"added": F.col("m").isNull(), "changed": F.col("m").isNotNull() & F.col("f").isNotNull() & differs, "missing": F.col("f").isNull()}
    return m.join(f, "path", "full"), states


def stale_counts(manifest: DataFrame, files: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """One row ``added, changed, missing``: files against a manifest by size and time, without reading them."""
    both, states = _compared(manifest, files, tolerance)
    return both.agg(*[F.coalesce(F.sum(F.when(is_so, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(x) for x, is_so in states.items()])


def stale_files(manifest: DataFrame, files: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """``path, state`` of the files that ``stale_counts`` counts."""
    both, states = _compared(manifest, files, tolerance)
    state = F.coalesce(*[F.when(is_so, x) for x, is_so in states.items()])
    return both.select("path", state.alias("state")).where("state is not null")


def status_by_type(passages: DataFrame) -> DataFrame:
    """``doc_type, passages, files``: of each kind of material."""
    return passages.groupBy(F.coalesce("doc_type", F.lit("other")).alias("doc_type")).agg(
        F.count_distinct("row_id").alias("passages"), F.count_distinct("path").alias("files")
    )
