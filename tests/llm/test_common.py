import os

from placeloom.llm import common


def test_stored_tables_can_be_dropped(spark):
    common.drop_stored(spark)
    kept = common.stored(spark.range(5), "kept")
    folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file://"))
    assert kept.count() == 5 and os.path.isdir(folder)
    assert common.drop_stored(spark) == 1 and not os.path.exists(folder) and common.drop_stored(spark) == 0
