import time

from siltstone.functions import session
from siltstone.llm import _shared


def left_over(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_") and name.endswith(".data")}


def test_no_shuffle_files_stay_after_a_write(spark):
    for write in (_shared.written, session.stored):
        before = left_over(spark)
        made = write(spark.range(1000).groupBy("id").count(), "sums")
        until = time.time() + 20
        while left_over(spark) - before and time.time() < until:  # they go in the background
            time.sleep(0.1)
        assert left_over(spark) <= before and made.count() == 1000
    assert spark.conf.get(_shared.CLEANUP) == "false"
