"""Views of the driver's tables as the data model: peaks, spectra, targets, arrays, metadata and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str, pos: bool = False) -> DataFrame:
    """lineitem as peaks; positions cost a sort, so only where asked for."""
    out = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("spectrum_index"), (F.col("l_extendedprice") / 100.0).alias("mz"), F.col("l_quantity").alias("intensity"),
        F.floor(F.col("l_extendedprice") / 100.0 / S.MZ_WIDTH).alias("mz_bin"),
    )
    w = Window.partitionBy("spectrum_index").orderBy("mz")
    return out.withColumn("pos", (F.row_number().over(w) - 1).cast("int")) if pos else out


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    polarity = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(0)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("spectrum_index"), F.col("o_custkey").alias("run_id"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("rt"), level.alias("ms_level"), polarity.alias("polarity"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mz = F.col("p_retailprice") / 10.0
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), mz.alias("target_mz"), (mz - 0.5).alias("lo"), (mz + 0.5).alias("hi"))


def scan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("spectrum_index"), F.col("value").alias("rt"), F.col("ts"))


PART_COLUMNS = {"p_name": 1000001, "p_brand": 1000002, "p_type": 1000003, "p_size": 1000004, "p_retailprice": 1000005}
