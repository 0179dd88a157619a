"""Byte-range planning: which ranges a read touches, and joining near ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from . import scans


def merge_ranges(ranges: DataFrame, gap: int = 0, by: list[str] | None = None, parts: int = 256) -> DataFrame:
    """Ranges(offset, length) joined where the next begins at most `gap` behind the end so far; empty ones are left out.

    Without `by` all ranges are one list. It is cut into `parts` stretches of offsets, which are dealt with side by
    side: each learns the largest end before it, and how many joined ranges begin there, from a row for each stretch.
    """
    by = by or []
    rows = ranges.where("length > 0").withColumn("end", F.col("offset") + F.col("length"))
    if by:
        w = Window.partitionBy(*by).orderBy("offset", "length")
        last = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("new", F.when(last.isNull() | (F.col("offset") > last + gap), 1).otherwise(0))
        rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        low, high = rows.agg(F.min("offset"), F.max("offset")).first()
        size = max(1, -(-((high or 0) - (low or 0) + 1) // parts))
        rows = rows.withColumn("part", F.floor((F.col("offset") - F.lit(low or 0)) / size).cast("int"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each part
        ends = rows.groupBy("part").agg(F.max("end").alias("e")).select("part", F.max("e").over(before).alias("end_before"))
        w = Window.partitionBy("part").orderBy("offset", "length")
        rows = rows.join(F.broadcast(ends), "part")
        last = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("end_before"))
        rows = rows.withColumn("new", F.when(last.isNull() | (F.col("offset") > last + gap), 1).otherwise(0))
        begun = rows.groupBy("part").agg(F.sum("new").alias("k")).select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("begun"))
        rows = rows.join(F.broadcast(begun), "part").withColumn("island", F.col("begun") + F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*by, "island").agg(F.min("offset").alias("offset"), F.max("end").alias("end"))
    return out.select(*by, "offset", (F.col("end") - F.col("offset")).alias("length"))


def window_directory(peaks: DataFrame) -> DataFrame:
    """Spectra with peaks in each window."""
    return peaks.groupBy("mz_bin").agg(F.count_distinct("spectrum_index").alias("n_spectra"), F.count("*").alias("n_peaks"))


def window_starts(peaks: DataFrame) -> DataFrame:
    """First entry of each window in the list of (window, spectrum) entries; windows number at most 2**20."""
    sizes = window_directory(peaks)
    w = Window.orderBy("mz_bin").rowsBetween(Window.unboundedPreceding, -1)  # one row for each window
    return sizes.select("mz_bin", F.coalesce(F.sum("n_spectra").over(w), F.lit(0)).cast("long").alias("start"), "n_spectra")


def entries(peaks: DataFrame) -> DataFrame:
    """The (window, spectrum) entries with their first position and count: addresses of stored pieces."""
    return peaks.groupBy("mz_bin", "spectrum_index").agg(F.min("pos").alias("first"), F.count("*").alias("count"))


def extracted_ion_blocks(spectra: DataFrame, peaks: DataFrame, mz: scans.Range, rt: scans.Range | None = None, per_block: int = 1024) -> DataFrame:
    """Distinct blocks (window, block of spectra) that an extracted-ion read touches. Spectra with NaN rt are read."""
    mz.checked()
    lo, hi = (max(0, int(x // S.MZ_WIDTH)) for x in (mz.lo, mz.hi))
    chosen = scans.select_scans(spectra, rt, keep_nan=True).select("spectrum_index")
    hit = peaks.where(F.col("mz_bin").between(lo, hi)).select("mz_bin", "spectrum_index").join(chosen, "spectrum_index", "left_semi")
    return hit.select("mz_bin", F.floor(F.col("spectrum_index") / per_block).alias("block")).distinct()


def block_ranges(blocks: DataFrame, wanted: DataFrame, gap: int = 0) -> DataFrame:
    """Merged byte ranges of wanted blocks(mz_bin, block) in a catalogue blocks(mz_bin, block, offset, length)."""
    return merge_ranges(blocks.join(wanted, ["mz_bin", "block"], "left_semi").select("offset", "length"), gap)


def metadata_group(items: DataFrame, groups: DataFrame | None = None, index: str = "item_index") -> DataFrame:
    """The metadata group of items: number, first and last item; with groups(group, offset, length) also its range."""
    g = F.floor(F.col(index) / S.GROUP_ITEMS)
    out = items.withColumns({"group": g, "first_item": g * S.GROUP_ITEMS, "last_item": (g + 1) * S.GROUP_ITEMS - 1})
    return out if groups is None else out.join(groups, "group", "left")


def open_ranges(sections: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Ranges that opening a container reads, of sections(section, offset, length)."""
    return sections.where(F.col("section").isin(*names) & (F.col("length") > 0)).orderBy("offset", "length")


def require_windows(peaks: DataFrame) -> DataFrame:
    """peaks, if it has window numbers; without them raises Missing, and Malformed if they are no whole numbers."""
    kind = dict(peaks.dtypes).get("mz_bin")
    if kind is None:
        raise S.Missing("the dataset has no window numbers")
    if kind not in ("bigint", "int"):
        raise S.Malformed(f"window numbers of type {kind}")
    return peaks
