"""Streams of scans: files as they come, order checks with state, and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema as S


def scan_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Scans from a folder of Parquet files, in micro-batches of bounded size."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rt_violations(stream: DataFrame) -> DataFrame:
    """Scans(run_id, spectrum_index, rt) whose finite rt is below the last finite one of their run, across micro-batches.

    The state of a run is its last finite rt. Within a micro-batch scans go by index.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("spectrum_index")
        bad = []
        for index, rt in zip(rows["spectrum_index"], rows["rt"]):
            if rt is None or rt != rt or rt in (float("inf"), float("-inf")):
                continue
            if last is not None and rt < last:
                bad.append((key[0], index, rt, last))
            last = rt
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(bad, columns=["run_id", "spectrum_index", "rt", "previous_rt"])

    rows = stream.select(F.col("run_id").cast("long").alias("run_id"), F.col("spectrum_index").cast("long").alias("spectrum_index"), F.col("rt").cast("double").alias("rt"))
    return rows.groupBy("run_id").applyInPandasWithState(step, "run_id long, spectrum_index long, rt double, previous_rt double", "last double", "append", GroupStateTimeout.NoTimeout)


def window_totals(stream: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of scans by run and tumbling window of time, with late rows up to a bound."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), "run_id").agg(F.count("*").alias("n"), F.sum("rt").alias("total"))


def mz_windows(stream: DataFrame, width: float = S.MZ_WIDTH) -> DataFrame:
    """Counts by m/z window: tumbling windows over values."""
    from ..functions import scalar as fn

    return stream.groupBy(fn.window_index(F.col("mz"), width).alias("mz_bin")).agg(F.count("*").alias("n"), F.sum("intensity").alias("total"))


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Starts appending a stream to a Parquet dataset; exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
