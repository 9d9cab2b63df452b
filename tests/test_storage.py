from voxelloom import storage


def test_tables_are_kept_and_removed(spark):
    storage.clean(spark)
    table = storage.durable(spark.range(5))
    assert table.count() == 5 and len(table.inputFiles()) > 0
    assert storage.clean(spark) == 1 and storage.clean(spark) == 0
