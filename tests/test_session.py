import os

import pytest

from txgraph.session import remove_scratch, scratch_dir, scratch_path, scratch_scope


def _local(path):
    return path.removeprefix("file:")


def test_scratch_tables_go_with_their_scope(spark):
    before = scratch_path(spark, "before")
    spark.range(3).write.parquet(before)
    with scratch_scope(spark) as paths:
        gone, kept = scratch_path(spark, "gone"), scratch_path(spark, "kept")
        for p in (gone, kept):
            spark.range(5).write.parquet(p)
        paths.remove(kept)
        never = scratch_path(spark, "never-written")
    assert not os.path.exists(_local(gone)) and not os.path.exists(_local(never))
    assert spark.read.parquet(kept).count() == 5 and spark.read.parquet(before).count() == 3
    with pytest.raises(RuntimeError):
        with scratch_scope(spark):
            held = scratch_path(spark, "held")
            spark.range(2).write.parquet(held)
            raise RuntimeError
    assert spark.read.parquet(held).count() == 2
    with pytest.raises(ValueError):
        remove_scratch(spark, "/tmp/elsewhere")
    for p in (before, kept, held):
        remove_scratch(spark, p)
        assert p.startswith(scratch_dir(spark)) and not os.path.exists(_local(p))
