"""Streams: running moments equal the batch, and buffered periods close with the watermark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from eddyforge.config import default
from eddyforge.streaming import period_stream, stateful_periods

CFG = default(period__averaging_minutes=1, period__acquisition_frequency=1)


def rows(spark):
    return spark.range(1, 301).select((F.col("id") * 1_000_000).alias("key_us"), *[(F.col("id") % k).cast("double").alias(n) for n, k in (("u", 7), ("v", 5), ("w", 11), ("ts", 13), ("co2", 3), ("h2o", 17))])


def test_running_moments_equal_the_batch(spark, tmp_path):
    df = rows(spark)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    want = {r["period_end_us"]: r for r in period_stream(df, CFG).collect()}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = period_stream(stream, CFG).writeStream.outputMode("complete").format("memory").queryName("moments").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("moments").collect()
    assert len(got) == len(want) == 5
    for r in got:
        assert r["n"] == want[r["period_end_us"]]["n"] and abs(r["cov_u_w"] - want[r["period_end_us"]]["cov_u_w"]) < 1e-9


def test_buffered_periods_close(spark, tmp_path):
    df = rows(spark)
    for k in range(3):
        df.where(f"key_us > {k * 100_000_000} and key_us <= {(k + 1) * 100_000_000}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def finish(data: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"period_end_us": [int(data["period_end_us"].iloc[0])], "n": [len(data)], "u_median": [float(data["u"].median())]})

    out = stateful_periods(stream, CFG, finish, "period_end_us long, n long, u_median double")
    q = out.writeStream.outputMode("append").format("memory").queryName("closed").start()
    q.processAllAvailable()
    q.stop()
    got = {r["period_end_us"]: (r["n"], r["u_median"]) for r in spark.table("closed").collect()}
    assert 60_000_000 in got and got[60_000_000] == (60, 3.0)
