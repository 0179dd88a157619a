"""Order checks and computations that depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn


def rt_order_violations(scans: DataFrame, by: str = "run_id", index: str = "spectrum_index", rt: str = "rt") -> DataFrame:
    """Rows whose finite rt is below the last finite rt before them in their run; others are skipped and change nothing."""
    finite = F.when(fn.is_finite(F.col(rt)), F.col(rt))
    before = Window.partitionBy(by).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    out = scans.withColumn("previous_rt", F.last(finite, ignorenulls=True).over(before))
    return out.where(fn.is_finite(F.col(rt)) & (F.col(rt) < F.col("previous_rt")))


def rt_ascending(scans: DataFrame, by: str = "run_id", index: str = "spectrum_index", rt: str = "rt") -> DataFrame:
    """Per run whether every rt is finite and none is below the one before."""
    w = Window.partitionBy(by).orderBy(index)
    ok = fn.is_finite(F.col(rt)) & (F.lag(rt).over(w).isNull() | (F.col(rt) >= F.lag(rt).over(w)))
    return scans.select(by, F.coalesce(ok, F.lit(False)).alias("ok")).groupBy(by).agg(F.bool_and("ok").alias("ascending"))


def mz_order_violations(peaks: DataFrame, by: str = "spectrum_index") -> DataFrame:
    """Peaks whose m/z is below the one before by position; comparisons with NaN never fail."""
    w = Window.partitionBy(by).orderBy("pos")
    out = peaks.withColumn("previous_mz", F.lag("mz").over(w))
    return out.where((F.col("mz") < F.col("previous_mz")) & ~F.isnan("mz") & ~F.isnan("previous_mz"))


def sorted_array(values: Column) -> Column:
    """Whether an array has no element below the one before it (NaN is never below or above)."""
    n = F.size(values)
    below = lambda i: (F.get(values, i) < F.get(values, i - 1)) & ~F.isnan(F.get(values, i)) & ~F.isnan(F.get(values, i - 1))
    return F.when(n < 2, F.lit(True)).otherwise(~F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), below))


def segments(peaks: DataFrame, by: str = "spectrum_index", width_column: str = "mz_bin") -> DataFrame:
    """Runs of peaks in the same window by position: window, first position and end, one row for each run."""
    w = Window.partitionBy(by).orderBy("pos")
    change = F.when(F.col(width_column) == F.lag(width_column).over(w), 0).otherwise(1)
    runs = peaks.withColumn("change", change).withColumn("segment", F.sum("change").over(w))
    return runs.groupBy(by, "segment", width_column).agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("end"))


def segment_groups(table: DataFrame, by: str, order: str, flag: str) -> DataFrame:
    """Numbers arrays by continuation flags: 0 begins one, 1 goes on. A leading 1 or another flag raises."""
    w = Window.partitionBy(by).orderBy(order)
    n = F.sum(1 - F.col(flag)).over(w)
    bad = F.when(~F.col(flag).isin(0, 1) | (n < 1), F.raise_error(F.lit("bad continuation flag")).cast("long"))
    return table.withColumn("array_no", F.coalesce(bad, n - 1).cast("long"))


def running_offsets(table: DataFrame, by: list[str], order: str, length: str, out: str = "offset") -> DataFrame:
    """Offsets as sums of the lengths before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn(out, F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def ordinals(table: DataFrame, by: list[str], order: str, out: str = "ordinal") -> DataFrame:
    return table.withColumn(out, (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long"))


def delta_encode(table: DataFrame, by: str, order: str, value: str, out: str = "delta") -> DataFrame:
    """Differences to the value before; the first is the value itself."""
    w = Window.partitionBy(by).orderBy(order)
    return table.withColumn(out, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def delta_decode(table: DataFrame, by: str, order: str, delta: str = "delta", out: str = "value") -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn(out, F.sum(delta).over(w))


def cuts_of(sample: list, parts: int) -> list:
    """Values that cut a sample into `parts` stretches, or fewer."""
    values = sorted(set(sample))
    return [values[len(values) * k // parts] for k in range(1, parts)] if len(values) > parts else values[1:]


def stretch(value: Column, cuts: list) -> Column:
    """The number of cuts at or below the value, by halves; NaN is above all."""

    def of(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), of(lo, mid)).otherwise(of(mid + 1, hi))

    return of(0, len(cuts))


def global_ordinals(table: DataFrame, order: list[str], out: str = "ordinal", parts: int = 64) -> DataFrame:
    """Numbers from 0 over the whole table by `order`, without a single-partition window.

    Rows are dealt into `parts` stretches of the first column, at values of a bounded sample, so that a row's stretch
    follows from its value alone; they are numbered within stretches, and offsets come from a row for each stretch.
    """
    first = order[0]
    n = table.count()
    sample = table.select(first).where(F.col(first).isNotNull()).sample(min(1.0, 100 * parts / max(n, 1)), 11).collect()
    cuts = cuts_of([r[0] for r in sample], parts)
    part = F.when(F.col(first).isNull(), F.lit(-1)).otherwise(stretch(F.col(first), cuts))  # nulls first, as in the order
    ordered = table.withColumn("__p", part).withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each stretch
    base = table.groupBy(part.alias("__p")).agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return ordered.join(F.broadcast(base), "__p").withColumn(out, (F.col("__base") + F.col("__i") - 1).cast("long")).drop("__p", "__i", "__base")
