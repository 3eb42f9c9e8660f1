import os

from tollguard.session import materialize, remove_scratch, scratch_path, scratch_scope, shared_dir


def folders(spark):
    top = shared_dir(spark).removeprefix("file:")
    return [d for d, _, files in os.walk(top) if any(f.endswith(".parquet") for f in files)]


def test_a_scope_removes_its_tables_and_no_others(spark):
    kept = materialize(spark.range(3))
    before = sorted(folders(spark))
    with scratch_scope(spark):
        inner = materialize(spark.range(5))
        with scratch_scope(spark):
            assert materialize(spark.range(7)).count() == 7
        assert inner.count() == 5 and len(folders(spark)) == len(before) + 1
    assert sorted(folders(spark)) == before and kept.count() == 3


def test_paths_are_named_by_application(spark):
    assert spark.sparkContext.applicationId in scratch_path(spark, "x")
    assert callable(remove_scratch)
