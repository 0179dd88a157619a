"""Checks of datasets and containers; each returns the rows that fail, or one row for each check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S


def section_overlaps(sections: DataFrame, by: str | None = None) -> DataFrame:
    """Sections(offset, length) that the next one begins within."""
    keys = [by] if by else []
    rows = sections.where("length > 0")
    following = F.lead("offset").over(Window.partitionBy(*keys).orderBy("offset", "length"))
    return rows.withColumn("next_offset", following).where(F.col("next_offset") < F.col("offset") + F.col("length"))


def misaligned(sections: DataFrame, to: int = 8) -> DataFrame:
    return sections.where((F.col("length") > 0) & (F.col("offset") % to != 0))


def outside(sections: DataFrame, begin: int, end: int) -> DataFrame:
    return sections.where((F.col("length") > 0) & ((F.col("offset") < begin) | (F.col("offset") + F.col("length") > end)))


def window_too_large(peaks: DataFrame) -> DataFrame:
    return peaks.where(F.col("mz_bin") > S.MAX_WINDOW)


def bad_indices(entries: DataFrame, index: str, count: int) -> DataFrame:
    return entries.where((F.col(index) < 0) | (F.col(index) >= count))


def unordered_entries(entries: DataFrame) -> DataFrame:
    """Entries(mz_bin, row_no, spectrum_index) whose spectrum is not above the one before in its window."""
    w = Window.partitionBy("mz_bin").orderBy("row_no")
    return entries.withColumn("previous", F.lag("spectrum_index").over(w)).where(F.col("spectrum_index") <= F.col("previous"))


def bad_starts(starts: DataFrame, count: int) -> DataFrame:
    """Window starts(row_no, start) that do not go from 0 to count without falling; one row for each window."""
    w = Window.orderBy("row_no")  # at most MAX_WINDOW rows
    rows = starts.withColumns({"previous": F.lag("start").over(w), "following": F.lead("start").over(w)})
    wrong = (F.col("previous").isNull() & (F.col("start") != 0)) | (F.col("start") < F.col("previous")) | (F.col("following").isNull() & (F.col("start") != count))
    return rows.where(wrong)


def unknown_dtypes(addresses: DataFrame) -> DataFrame:
    return addresses.where(~F.col("dtype").isin(*S.DTYPE_BYTES))


def missing_items(entries: DataFrame, spectra: DataFrame) -> DataFrame:
    return entries.join(spectra.select("spectrum_index"), "spectrum_index", "left_anti")


def require_empty(violations: DataFrame, message: str) -> None:
    row = violations.limit(1).collect()
    if row:
        raise S.Malformed(f"{message}: {row[0].asDict()}")


def check_run(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """(check_no, label, violations, passed) of a run."""
    from . import order

    checks = [
        ("m/z in order", order.mz_order_violations(peaks)),
        ("rt in order", order.rt_order_violations(spectra)),
        ("window numbers in bounds", window_too_large(peaks)),
        ("peaks belong to spectra", missing_items(peaks, spectra)),
    ]
    out = None
    for i, (label, bad) in enumerate(checks):
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(i).alias("check_no"), F.lit(label).alias("label"), "violations", (F.col("violations") == 0).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out
