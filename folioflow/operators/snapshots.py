"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.plans.runtime import cut, numbered

#: Snapshot numbers are few (one per delivery date); beyond this they are numbered and joined in tasks, not listed.
MOST_SNAPSHOTS = 100_000


def normal_path(path: Column) -> Column:
    """``\\`` as ``/`` and a leading ``./`` dropped."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def snapshot_changes(
    manifest: DataFrame,
    snapshot: str = "snapshot_no",
    delivery: str = "delivery_no",
    path: str = "path",
    content_hash: str = "hash",
    size: str = "size",
    mtime: str = "mtime",
    tolerance: float = 1.0,
) -> DataFrame:
    """Files added, removed and changed between each snapshot and the next lower one that exists.

    Both sides of each comparison are tagged and united (a row is the new side of its own snapshot
    and the old side of the following one), grouped once by (comparison, path), and classified from
    the one record each side keeps. That is one shuffle of narrow rows with a partial aggregate
    before it, so a path that holds a third of all rows is reduced before it moves.

    The per-side record of a path is the row of highest ``mtime`` (null lowest; ties: the highest
    hash, then size, so the result is fixed). Two records with hashes differ if the hashes do,
    ignoring case and blanks around; if either hash is null they differ if the sizes do (a null size
    equals only null) or if both mtimes are present and further apart than ``tolerance`` seconds.

    Empty input, or a single snapshot, gives no rows. Rows with a null snapshot number or a null
    path belong to no snapshot or file and are left out. Extra columns are ignored.

    Returns ``snapshot_no int, path string, change_kind string, old_hash, new_hash``.
    """
    m = manifest.select(
        F.col(snapshot).alias("snap"),
        F.coalesce(F.col(delivery), F.lit(-1)).alias("delivery"),
        normal_path(F.col(path)).alias("path"),
        F.lower(F.trim(F.col(content_hash))).alias("h"),
        F.col(size).alias("size"),
        F.col(mtime).alias("mtime"),
    ).where("snap is not null and path is not null")

    # One row per snapshot: its last delivery and the snapshot that follows it.
    per_snapshot = manifest.where(F.col(snapshot).isNotNull()).groupBy(F.col(snapshot).alias("snap")).agg(
        F.max(F.coalesce(F.col(delivery), F.lit(-1))).alias("last")
    )
    listed = per_snapshot.limit(MOST_SNAPSHOTS + 1).collect()
    if len(listed) <= MOST_SNAPSHOTS:
        numbers = sorted((r["snap"], r["last"]) for r in listed)
        following = [
            (s, d, numbers[i + 1][0] if i + 1 < len(numbers) else None, i == 0)
            for i, (s, d) in enumerate(numbers)
        ]
        steps = manifest.sparkSession.createDataFrame(following, "snap bigint, delivery bigint, next bigint, first boolean")
        m = m.join(F.broadcast(steps), ["snap", "delivery"])
    else:
        placed = cut(numbered(per_snapshot.withColumn("every", F.lit(1)), ["every"], ["snap"]))
        later = placed.select((F.col("turn") - 1).alias("turn"), F.col("snap").alias("next"))
        steps = placed.join(later, "turn", "left").select("snap", F.col("last").alias("delivery"), "next", (F.col("turn") == 1).alias("first"))
        m = m.join(steps, ["snap", "delivery"])

    record = F.struct(F.col("mtime").isNotNull().alias("known"), "mtime", "h", "size")
    sides = m.select(
        "path",
        record.alias("rec"),
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.when(~F.col("first"), F.col("snap").cast("long")).alias("at"), F.lit(True).alias("new")),
                    F.struct(F.col("next").cast("long").alias("at"), F.lit(False).alias("new")),
                ),
                lambda s: s["at"].isNotNull(),
            )
        ).alias("side"),
    )
    pairs = sides.groupBy(F.col("side.at").alias("at"), "path").agg(
        F.max(F.when(F.col("side.new"), F.col("rec"))).alias("n"),
        F.max(F.when(~F.col("side.new"), F.col("rec"))).alias("o"),
    )
    both_hashes = F.col("n.h").isNotNull() & F.col("o.h").isNotNull()
    apart = F.coalesce(F.abs(F.col("n.mtime") - F.col("o.mtime")) > tolerance, F.lit(False))
    changed = F.when(both_hashes, F.col("n.h") != F.col("o.h")).otherwise(
        ~F.col("n.size").eqNullSafe(F.col("o.size")) | apart
    )
    kind = (
        F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(changed, "changed")
    )
    return pairs.select(
        F.col("at").cast("int").alias("snapshot_no"),
        "path",
        kind.alias("change_kind"),
        F.col("o.h").alias("old_hash"),
        F.col("n.h").alias("new_hash"),
    ).where("change_kind is not null")
