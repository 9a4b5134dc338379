"""Structured Streaming forms of the engine.

``period_stream`` keeps running moments only, so its state is one row per open period.
``stateful_periods`` buffers the samples of each open period (medians and the lag search need them
all), drops what is not ahead of the last sample, and emits the period when the watermark passes its
end. A stream drops late samples where a batch run refuses them; the stream's progress counts them.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config
from ..plans.cut import period_bounds


def stamped(df: DataFrame, cfg: Config, delay: str) -> DataFrame:
    _, end = period_bounds(F.col("key_us"), cfg.window_us, cfg.period.closed)
    # The label as event time: the watermark then passes a period, not its samples.
    return df.withColumn("period_end_us", end).withColumn("period_end", F.timestamp_micros("period_end_us")).withWatermark("period_end", delay)


def period_stream(df: DataFrame, cfg: Config, delay: str = "0 seconds") -> DataFrame:
    """Counts, means and moments per period from a stream (or batch) of samples with key_us."""
    covs = (("u", "w"), ("v", "w"), ("w", "ts"), ("w", "co2"), ("w", "h2o"))
    g = stamped(df, cfg, delay).groupBy("period_end", "period_end_us")
    return g.agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"{n}_mean") for n in ("u", "v", "w", "ts", "co2", "h2o")], *[F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in covs])


def stateful_periods(df: DataFrame, cfg: Config, finish: Callable[[pd.DataFrame], pd.DataFrame], schema: str, delay: str = "0 seconds") -> DataFrame:
    """``finish`` gets each closed period's kept samples, in order, and returns its row or rows."""
    names = [c for c in df.columns if c != "period_end"]

    def held(state: GroupState) -> pd.DataFrame:
        return pd.read_json(io.StringIO(state.get[0]), orient="split", convert_dates=False)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            data = held(state)
            state.remove()
            yield finish(data.assign(period_end_us=int(key[1])))
            return
        parts = [held(state)] if state.exists else []
        data = pd.concat([*parts, *(b[names] for b in batches)], ignore_index=True)
        keep = data["key_us"] > data["key_us"].cummax().shift(fill_value=-(1 << 62))
        state.update((data[keep].to_json(orient="split", double_precision=15),))
        state.setTimeoutTimestamp(max(int(key[1]) // 1000, state.getCurrentWatermarkMs() + 1))

    g = stamped(df, cfg, delay).groupBy("period_end", "period_end_us")
    return g.applyInPandasWithState(step, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_counts(spark: SparkSession, sf_dir: str, cfg: Config) -> DataFrame:
    """Runs ``period_stream`` over the event table as a stream to its end; the result is a batch frame."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    e = stream.selectExpr("unix_micros(CAST(ts AS TIMESTAMP)) AS key_us", "(CAST(get_json_object(props,'$.k') AS INT) - 49.5e0)/50e0 AS g", "value")
    e = e.selectExpr("key_us", "2.0e0 - 0.56e0*g AS u", "0.05e0 + 0.7e0*g AS w", "value AS v", "293.15e0 + 0.6e0*g AS ts", "g AS co2", "g AS h2o")
    name = f"periods_{uuid.uuid4().hex}"
    query = period_stream(e, cfg).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.table(name)
    return out.select("period_end_us", "n", F.round("u_mean", 6).alias("u_mean"), F.round("cov_u_w", 6).alias("cov_u_w"))
