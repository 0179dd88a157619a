"""Summaries of spectra, chromatograms and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn

# Accessions that summaries read.
RT, MS_LEVEL, POSITIVE, NEGATIVE = "MS:1000016", "MS:1000511", "MS:1000130", "MS:1000129"
BASE_MZ, BASE_INT, TIC, SELECTED_MZ = "MS:1000504", "MS:1000505", "MS:1000285", "MS:1000744"
POSITION = {"position_x": "IMS:1000050", "position_y": "IMS:1000051", "position_z": "IMS:1000052"}


def spectrum_summaries(params: DataFrame) -> DataFrame:
    """Summary columns from params(spectrum_index, row_no, level, accession, value, unit_accession, unit_name).

    level tells where a parameter stands: spectrum, scan, scan_list or selected_ion. The last spectrum-level
    parameter wins; a start time is the first finite one of the scans, else of the scan list; positions come from
    the last scan that has one. Text that is not a number gives NaN, positions 0.
    """
    value = F.col("value").try_cast("double")
    number = F.coalesce(value, F.lit(float("nan")))
    own = F.col("level") == "spectrum"
    last = lambda when, x: F.max_by(x, F.when(when, F.col("row_no")))
    first = lambda when, x: F.min_by(x, F.when(when, F.col("row_no")))
    has = lambda a: F.col("accession") == a
    timed = has(RT) & fn.is_finite(value)
    unit = fn.time_unit(F.col("unit_accession"), F.col("unit_name"))
    nan = lambda x: F.coalesce(x, F.lit(float("nan")))
    scan, scan_list = timed & (F.col("level") == "scan"), timed & (F.col("level") == "scan_list")
    cells = {
        "ms_level": F.coalesce(last(own & has(MS_LEVEL), F.col("value").try_cast("short")), F.lit(0).cast("short")),
        "polarity": F.coalesce(last(own & F.col("accession").isin(POSITIVE, NEGATIVE), F.when(has(POSITIVE), 1).otherwise(2)), F.lit(0)).cast("short"),
        "rt": nan(F.coalesce(first(scan, value), first(scan_list, value))),
        "rt_unit": F.coalesce(first(scan, unit), first(scan_list, unit), F.lit(0)).cast("short"),
        "base_peak_mz": nan(last(own & has(BASE_MZ), number)),
        "base_peak_int": nan(last(own & has(BASE_INT), number)),
        "total_ion_current": nan(last(own & has(TIC), number)),
        "selected_ion_mz": nan(first((F.col("level") == "selected_ion") & has(SELECTED_MZ), number)),
    }
    for name, accession in POSITION.items():
        whole = F.col("value").try_cast("int")
        cells[name] = F.coalesce(last((F.col("level") == "scan") & has(accession), F.when(whole >= 0, whole)), F.lit(0))
    return params.groupBy("spectrum_index").agg(*(c.alias(n) for n, c in cells.items()))


def chromatogram_summaries(params: DataFrame, bounds: dict[str, str]) -> DataFrame:
    """Bounds (name -> accession) of chromatograms, the last value that is a number, and polarity."""
    value = F.col("value").try_cast("double")
    nan = lambda x: F.coalesce(x, F.lit(float("nan")))
    cells = [nan(F.max_by(value, F.when((F.col("accession") == a) & value.isNotNull(), F.col("row_no")))).alias(n) for n, a in bounds.items()]
    sign = F.max_by(F.when(F.col("accession") == POSITIVE, 1).otherwise(2), F.when(F.col("accession").isin(POSITIVE, NEGATIVE), F.col("row_no")))
    return params.groupBy("chromatogram_index").agg(*cells, F.coalesce(sign, F.lit(0)).cast("short").alias("polarity"))


def axis_maxima(spectra: DataFrame, peaks: DataFrame, width: float = S.MZ_WIDTH) -> DataFrame:
    """Largest finite rt (0 at least), bound of the last window with peaks, and largest positions, in one row."""
    rt = F.max(F.when(fn.is_finite(F.col("rt")), F.col("rt")))
    positions = [F.max(c).alias(f"max_{c[-1]}") for c in ("position_x", "position_y", "position_z") if c in spectra.columns]
    one = spectra.agg(F.greatest(F.coalesce(rt, F.lit(0.0)), F.lit(0.0)).alias("max_rt"), *positions)
    top = peaks.agg(F.coalesce((F.max("mz_bin") + 1) * F.lit(width), F.lit(0.0)).alias("max_mz"))
    return one.crossJoin(top)  # one row each


def distinct_kinds(arrays: DataFrame) -> DataFrame:
    """Number of array kinds in each section."""
    return arrays.groupBy("section").agg(F.count_distinct(F.when(F.col("accession") != 0, F.col("accession"))).alias("kinds"))


def end_of_addresses(slices: DataFrame) -> DataFrame:
    return slices.agg(F.max(F.col("first") + F.col("count")).alias("end"))
