"""Store upkeep on hand-made rows: unknown keys, nulls, undo, rows beyond the last slice."""

import pytest
from pyspark.sql import functions as F

from annalist.operators import maintenance


def test_replacing_unknown_rows_is_an_error(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    old, new = spark.createDataFrame([(2,), (3,)], "id long"), spark.createDataFrame([(9, "z")], "id long, name string")
    assert sorted(map(tuple, maintenance.replace_rows(store, old, new, "id").collect())) == [(1, "a"), (9, "z")]
    with pytest.raises(KeyError):
        maintenance.replace_rows(store, old, new, "id", must_exist=True)


def test_undo_finds_only_its_own_record(spark):
    store = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, cube string").withColumns({"is_deleted": F.lit(False), "record": F.lit(None).cast("string")})
    store = maintenance.delete_cube(maintenance.delete_cube(store, F.col("cube") == "x", "r1"), F.col("id") <= 2, "r2")
    assert [tuple(r) for r in store.orderBy("id").select("is_deleted", "record").collect()] == [(True, "r1"), (True, "r2"), (False, None)]
    back = maintenance.recover(store, "r2").orderBy("id").select("is_deleted", "record").collect()
    assert [tuple(r) for r in back] == [(True, "r1"), (False, None), (False, None)]


def test_slices_leave_out_what_no_length_covers(spark):
    rows = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(5)], "k long, i long")
    lengths = spark.createDataFrame([(1, [2, 0, 1]), (3, [4])], "k long, lengths array<int>")
    got = maintenance.slices(rows, lengths, "k", "i").orderBy("k", "i").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0), (1, 1, 0), (1, 2, 2)]


def test_updates_with_nulls(spark):
    store = spark.createDataFrame([(1, "s", "d"), (2, "s", None), (3, "s", "d")], "id long, summary string, details string")
    changes = spark.createDataFrame([(1, None, "n", "append"), (2, "t", "n", "append"), (3, None, None, "replace"), (4, "u", "n", "append")], "id long, summary string, details string, mode string")
    got = maintenance.update_events(store, changes, "id").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "s", "d\nn"), (2, "t", "n"), (3, "s", "d")]
    known = maintenance.merge_events(store, changes, "id", insert_missing=False)
    assert sorted(r["id"] for r in known.collect()) == [1, 2, 3]
