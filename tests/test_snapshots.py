from folioflow.operators import snapshots
from folioflow.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_no int, delivery_no int, path string, hash string, size bigint, mtime double, old_hash string"


def changes(spark, rows):
    out = snapshot_changes(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    return sorted(tuple(r)[:3] for r in out.collect())


def test_added_removed_changed_and_gaps(spark):
    rows = [
        (1, 1, "a", "H1", 1, 10.0),
        (1, 1, "b", "h2", 1, 10.0),
        (4, 1, "./a", " h1 ", 2, 99.0),
        (4, 1, "c\\d", "h3", 1, 10.0),
        (7, 1, "c/d", "h4", 1, 10.0),
        (7, 1, "a", "h1", 1, 10.0),
    ]
    assert changes(spark, rows) == [(4, "b", "removed"), (4, "c/d", "added"), (7, "c/d", "changed")]


def test_last_delivery_counts_and_highest_mtime_wins(spark):
    rows = [
        (1, 1, "a", "h1", 1, 10.0),
        (2, 1, "gone", "x", 1, 10.0),
        (2, 2, "a", "h9", 1, None),
        (2, 2, "a", "h1", 1, 11.0),
        (2, 2, "a", "h1", 1, 11.0),
    ]
    assert changes(spark, rows) == []


def test_null_hash_falls_back_to_size_and_mtime(spark):
    rows = [
        (1, 1, "same", None, 1, 10.0), (2, 1, "same", "h", 1, 11.0),
        (1, 1, "late", None, 1, 10.0), (2, 1, "late", "h", 1, 11.5),
        (1, 1, "big", "h", 1, 10.0), (2, 1, "big", None, 2, 10.0),
        (1, 1, "nomtime", "h", 1, None), (2, 1, "nomtime", None, 1, 10.0),
    ]
    assert changes(spark, rows) == [(2, "big", "changed"), (2, "late", "changed")]


def test_empty_single_and_null_keys(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(1, 1, "a", "h", 1, 1.0)]) == []
    assert changes(spark, [(None, 1, "a", "h", 1, 1.0), (1, None, None, "h", 1, 1.0)]) == []


def test_very_many_snapshots_are_compared_alike(spark, monkeypatch):
    rows = [(n, 1, f"p{(n + k) % 5}", f"h{n % 3}", 1, 1.0) for n in range(1, 9, 2) for k in range(3)]
    listed = changes(spark, rows)
    monkeypatch.setattr(snapshots, "MOST_SNAPSHOTS", 1)
    assert listed and changes(spark, rows) == listed
