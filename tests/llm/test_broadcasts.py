"""What Spark may broadcast by itself."""

import pytest
from pyspark.sql import functions as F
from workfeed.llm import nearcopies, simhash
from workfeed.llm.common import small_broadcasts

NAME = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def threshold(spark):
    had = spark.conf.get(NAME)
    yield lambda value: spark.conf.set(NAME, value)
    spark.conf.set(NAME, had)


@pytest.mark.parametrize("had, want", [("10MB", "262144"), ("10485760b", "262144"), ("64k", "64k"), ("-1", "-1")])
def test_a_lower_threshold_stays(spark, threshold, had, want):
    threshold(had)
    small_broadcasts(spark)
    assert spark.conf.get(NAME) == want


def test_exploded_keys_are_never_broadcast(spark, threshold, monkeypatch):
    threshold("10MB")
    plans = []

    def kept(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return spark.createDataFrame(rows, df.schema)

    for module in (simhash, nearcopies):
        monkeypatch.setattr(module, "checkpoint", kept)
    prints = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    kept(simhash.near_fingerprints(prints, 2))
    kept(nearcopies.candidates(prints.select(F.col("fp").alias("node"), F.posexplode(F.array(*(F.col("fp") % (100 + k) for k in range(9)))).alias("slot", "key")), 64, 4)[0])
    assert len(plans) == 4 and not any("BroadcastHashJoin" in p for p in plans)
