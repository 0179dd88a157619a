"""Point reads, range reads, scans and extracted-ion queries over spectra and peaks in long form."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn


@dataclass(frozen=True)
class Range:
    """A range with both ends inside."""

    lo: float
    hi: float

    def checked(self) -> Range:
        if not (math.isfinite(self.lo) and math.isfinite(self.hi)) or self.lo > self.hi:
            raise BadRange(f"bad range {self.lo}..{self.hi}")
        return self


BadRange = S.BadRange


def in_mz(mz: Column, bin_: Column | None, r: Range, width: float = S.MZ_WIDTH) -> Column:
    """m/z in the range. The condition on the stored window number prunes files and row groups; the other is exact."""
    r.checked()
    exact = mz.between(r.lo, r.hi)
    if bin_ is None:
        return exact
    low = math.floor(r.lo / width) if r.lo > 0 else 0
    high = math.floor(r.hi / width) if r.hi > 0 else 0
    return bin_.between(low, high) & exact


def in_rt(rt: Column, r: Range | None, keep_nan: bool = False) -> Column:
    """rt in the range. Reversed bounds select nothing. NaN is out, or in with keep_nan (extracted-ion plans)."""
    if r is None:
        return F.lit(True)
    if math.isnan(r.lo) or math.isnan(r.hi):
        raise BadRange("rt bounds must not be NaN")
    inside = rt.between(r.lo, r.hi)
    return (F.isnan(rt) | inside) if keep_nan else (~F.isnan(rt) & inside)


def select_scans(spectra: DataFrame, rt: Range | None = None, ms_level: int | None = None, keep_nan: bool = False) -> DataFrame:
    out = spectra.where(in_rt(F.col("rt"), rt, keep_nan))
    return out if ms_level is None else out.where(F.col("ms_level") == ms_level)


def with_both_axes(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """Spectra that have peaks at all: those without either array are skipped by scans.

    Spectra of the native store hold the number of their peaks; without it all peaks are looked at.
    """
    if "n_peaks" in spectra.columns:
        return spectra.where("n_peaks > 0")
    return spectra.join(peaks.select("spectrum_index").distinct(), "spectrum_index", "left_semi")


def peaks_in(peaks: DataFrame, mz: Range, width: float = S.MZ_WIDTH) -> DataFrame:
    bin_ = F.col("mz_bin") if "mz_bin" in peaks.columns else None
    return peaks.where(in_mz(F.col("mz"), bin_, mz, width))


def scans_in(spectra: DataFrame, peaks: DataFrame, mz: Range, rt: Range | None = None, ms_level: int | None = None) -> DataFrame:
    """A row for each selected spectrum that has arrays: its columns, and m/z and intensity of its peaks in range, by m/z.

    Spectra without a peak in range come with empty arrays.
    """
    chosen = with_both_axes(select_scans(spectra, rt, ms_level), peaks)
    pairs = peaks_in(peaks, mz).groupBy("spectrum_index").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("pairs"))
    out = chosen.join(pairs, "spectrum_index", "left")
    empty = F.array().cast("array<double>")
    return out.withColumns({"mz": F.coalesce(F.col("pairs.mz"), empty), "intensity": F.coalesce(F.col("pairs.intensity"), empty)}).drop("pairs")


def extracted_ion(spectra: DataFrame, peaks: DataFrame, mz: Range, rt: Range | None = None, ms_level: int | None = None) -> DataFrame:
    """Extracted-ion chromatogram: per selected spectrum the sum, the count and the base peak of its peaks in range (0 and null without any)."""
    hits = peaks_in(peaks, mz).groupBy("spectrum_index").agg(
        F.sum("intensity").alias("xic"), F.count("*").alias("n_points"), F.max(F.struct("intensity", (-F.col("mz")).alias("m"))).alias("top")
    )
    out = select_scans(spectra, rt, ms_level).select("spectrum_index", "rt").join(hits, "spectrum_index", "left")
    return out.select(
        "spectrum_index", "rt", F.coalesce("xic", F.lit(0.0)).alias("xic"), F.coalesce("n_points", F.lit(0)).alias("n_points"),
        F.col("top.intensity").alias("base_int"), (-F.col("top.m")).alias("base_mz"),
    )


def totals(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """Total ion current and base peak (the least m/z of equals) of every spectrum."""
    hits = peaks.groupBy("spectrum_index").agg(F.sum("intensity").alias("tic"), F.max(F.struct("intensity", (-F.col("mz")).alias("m"))).alias("top"))
    out = spectra.select("spectrum_index").join(hits, "spectrum_index", "left")
    return out.select("spectrum_index", F.coalesce("tic", F.lit(0.0)).alias("tic"), F.col("top.intensity").alias("bpc"), (-F.col("top.m")).alias("base_mz"))


def top_peaks(peaks: DataFrame, k: int) -> DataFrame:
    """The k largest peaks of each spectrum, ties by m/z, with their rank from 1.

    A ranked window with a bound: each task keeps k peaks of a spectrum before they are shuffled.
    """
    w = Window.partitionBy("spectrum_index").orderBy(F.desc("intensity"), "mz")
    ranked = peaks.select("spectrum_index", "mz", "intensity", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    return ranked.select("spectrum_index", "rank", "mz", "intensity")


def counts(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """One row: n_spectra and n_peaks. Spectra that hold the number of their peaks are enough."""
    if "n_peaks" in spectra.columns:
        return spectra.agg(F.count("*").alias("n_spectra"), F.coalesce(F.sum("n_peaks"), F.lit(0)).alias("n_peaks"))
    return spectra.agg(F.count("*").alias("n_spectra")).crossJoin(peaks.agg(F.count("*").alias("n_peaks")))  # one row each


def window_points(peaks: DataFrame, mz_bin: int, first: int, last: int) -> DataFrame:
    """Peaks of one window of the spectra first to last: both conditions are on columns that the store is sorted by."""
    return peaks.where((F.col("mz_bin") == mz_bin) & F.col("spectrum_index").between(first, last))


def spectrum_at(spectra: DataFrame, index: int) -> DataFrame:
    """The row of one spectrum; none if there is no such index."""
    return spectra.where(F.col("spectrum_index") == index)


def nth_scan(spectra: DataFrame, n: int) -> DataFrame:
    """The n-th spectrum counted from 1, as on the command line; out of range raises."""
    out = spectrum_at(spectra, n - 1)
    if n < 1 or out.isEmpty():
        raise S.OutOfRange(f"scan {n} is out of range")
    return out


def summaries(spectra: DataFrame) -> DataFrame:
    return spectra.select("spectrum_index", *[c for c in S.SUMMARY_COLUMNS if c in spectra.columns])


def pair_axes(x: Column, y: Column) -> Column:
    """Pairs by position, as many as the shorter array has."""
    n = F.least(F.size(x), F.size(y))
    return F.arrays_zip(F.slice(x, F.lit(1), n).alias("x"), F.slice(y, F.lit(1), n).alias("y"))


def slice_axis(x: Column, y: Column, r: Range) -> Column:
    """Pairs whose x is in range, in order; NaN is out. For any axis, sorted or not."""
    return F.filter(pair_axes(x, y), lambda p: ~F.isnan(p["x"].cast("double")) & p["x"].between(r.lo, r.hi))


def scan_columns(arrays: DataFrame, x: int | str = "mz", y: int | str = "intensity", r: Range | None = None) -> DataFrame:
    """x and y of each spectrum in arrays(spectrum_index, arrays: array<struct<accession, values>>), by accession or name.

    A missing kind gives empty arrays.
    """
    kind = lambda k: S.AXES.get(k, k)
    xs, ys = fn.first_array(F.col("arrays"), kind(x)), fn.first_array(F.col("arrays"), kind(y))
    pairs = slice_axis(xs, ys, r) if r else pair_axes(xs, ys)
    return arrays.select("spectrum_index", pairs.alias("p")).select("spectrum_index", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def visit(spectra: DataFrame, peaks: DataFrame, mz: Range, function, schema: str, **select) -> DataFrame:
    """function(iterator of pandas frames) over scans_in: user code for every selected scan."""
    return scans_in(spectra, peaks, mz, **select).mapInPandas(function, schema)
