"""The native store: Parquet datasets clustered for range reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

FORMAT_VERSION = 1


def write_run(path: str, spectra: DataFrame, peaks: DataFrame, width: float = S.MZ_WIDTH, level: int = 12, validate: bool = True, mode: str = "error") -> None:
    """Writes spectra and peaks below path; peaks are clustered by window, so range reads skip files and row groups.

    With validate, m/z that falls within a spectrum, finite rt that falls within a run and windows beyond the bound
    raise before anything is written.
    """
    from ..functions import scalar as fn
    from ..operators import order
    from ..operators import validate as v

    if "mz_bin" not in peaks.columns:
        peaks = peaks.withColumn("mz_bin", fn.window_index(F.col("mz"), width))
    if validate:
        v.require_empty(order.mz_order_violations(peaks), "m/z falls")
        v.require_empty(order.rt_order_violations(spectra), "rt falls")
        v.require_empty(v.window_too_large(peaks), "m/z value too large for window width")
    bucket = 1 if level <= 5 else 9 if level <= 10 else 12 if level <= 16 else 22
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(bucket)}
    peaks.repartitionByRange("mz_bin", "spectrum_index").sortWithinPartitions("mz_bin", "spectrum_index", "mz").write.options(**options).mode(mode).parquet(f"{path}/peaks")
    # Spectra hold the number of their peaks, so scans need not look at peaks outside their range.
    keys = [k for k in ("run_id", "spectrum_index") if k in spectra.columns and k in peaks.columns]
    sizes = peaks.groupBy(*keys).agg(F.count("*").alias("n_peaks"))
    spectra = spectra.drop("n_peaks").join(sizes, keys, "left").withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0)))
    spectra.repartitionByRange("spectrum_index").sortWithinPartitions("spectrum_index").write.options(**options).mode(mode).parquet(f"{path}/spectra")
    meta = spectra.sparkSession.createDataFrame([(json.dumps({"format_version": FORMAT_VERSION, "mz_width": width, "level": level}),)], "value string")
    meta.coalesce(1).write.mode(mode).text(f"{path}/meta")


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if not 0 <= meta["format_version"] <= FORMAT_VERSION:
        raise S.Unsupported(f"format version {meta['format_version']}")
    return spark.read.parquet(f"{path}/spectra"), spark.read.parquet(f"{path}/peaks"), meta


def to_json(df: DataFrame) -> DataFrame:
    """A JSON line for each row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
