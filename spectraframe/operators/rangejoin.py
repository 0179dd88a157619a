"""Joins of many m/z ranges with peaks."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from . import order


#: A level's step is so many times that of the level below; a target touches that many steps of its level, and one more.
FACTOR = 16


def _between(peaks: DataFrame, lo: float, hi: float, width: float) -> DataFrame:
    """Peaks with lo <= mz <= hi. Windows of the ends bound `mz_bin` where they say something: peaks below 0 or NaN may
    be filed under 0 or not, and windows end."""
    out = peaks.where(F.col("mz").between(lo, hi))
    if "mz_bin" in peaks.columns:
        if 0 < lo < S.MAX_WINDOW * width and not math.isnan(hi):
            out = out.where(F.col("mz_bin") >= math.floor(lo / width))
        if 0 <= hi < S.MAX_WINDOW * width:
            out = out.where(F.col("mz_bin") <= math.floor(hi / width))
    return out


def range_join(peaks: DataFrame, targets: DataFrame, step: float | None = None, salt: int = 1, width: float = S.MZ_WIDTH) -> DataFrame:
    """Pairs of peaks(mz, ...) and targets(lo, hi, ...) with lo <= mz <= hi.

    An equi-join on steps of m/z, with the range left as a condition: no nested loop. The step is about the targets'
    own mean width (or as given), so a peak meets few targets that it isn't in; wider targets have levels of coarser
    steps, so none is copied often. With salt > 1 peaks of a step are dealt over so many parts, for dense steps;
    targets are copied to each. Targets with null, NaN or reversed bounds join nothing. Peaks with `mz_bin` (of the
    given width) are read only in the windows between the least and the largest bound.
    """
    ok = targets.where("lo <= hi AND NOT isnan(lo) AND NOT isnan(hi)")
    wide = F.col("hi") - F.col("lo")
    finite = F.when(wide < float("inf"), wide)
    mean, lo, hi = ok.agg(F.avg(finite), F.min("lo"), F.max("hi")).first()
    if lo is None:  # no target joins anything
        lo, hi, mean = 1.0, 0.0, 1.0
    step = float(step or max(mean or 0.0, width / 4096))
    inside = _between(peaks, lo, hi, width)
    level = F.greatest(F.ceil(F.log(F.greatest(F.least(wide, F.lit(1e12)) / step, F.lit(1.0))) / math.log(FACTOR)) - 1, F.lit(0)).cast("int")
    leveled = ok.withColumn("__level", level)
    levels = sorted(r[0] for r in leveled.select("__level").distinct().collect())  # twelve at most
    scale = lambda c, n: F.floor(c / (step * float(FACTOR) ** n)).cast("long")
    bounded = lambda c: F.greatest(F.least(c, F.lit(1e15)), F.lit(-1e15))
    ends = None
    for n in levels:
        one = leveled.where(F.col("__level") == n)
        one = one.withColumn("__step", F.explode(F.sequence(scale(F.greatest(bounded(F.col("lo")), F.lit(float(max(lo, -1e15)))), n), scale(F.least(bounded(F.col("hi")), F.lit(float(min(hi, 1e15)))), n))))
        ends = one if ends is None else ends.unionByName(one)
    if ends is None:
        ends = leveled.withColumn("__step", F.lit(0).cast("long"))
    steps = F.array(*(F.struct(F.lit(n).alias("l"), scale(F.col("mz"), n).alias("s")) for n in levels or [0]))
    if len(levels) > 1:
        inside = inside.withColumn("__at", F.explode(steps))
        inside = inside.withColumns({"__level": F.col("__at.l"), "__step": F.col("__at.s")}).drop("__at")
        keys = ["__level", "__step"]
    else:
        inside, ends, keys = inside.withColumn("__step", scale(F.col("mz"), (levels or [0])[0])), ends.drop("__level"), ["__step"]
    if salt > 1:
        ends = ends.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        inside = inside.withColumn("__salt", F.pmod(F.xxhash64("mz"), F.lit(salt)).cast("int"))
        keys.append("__salt")
    return inside.join(ends, keys).where(F.col("mz").between(F.col("lo"), F.col("hi"))).drop(*keys)


#: Bits of a limb of an exact sum: a long holds the sum of 2**33 of them.
LIMB = 30


def _exact(rows: DataFrame, value: str) -> tuple[dict[str, Column], Callable[[Callable[[str], Column]], Column]]:
    """A column of doubles as columns of longs, and its sum from their sums (by name).

    Finite values are cut into limbs at fixed exponents, from the greatest value down to the last bit of the least (of
    1, if all are whole), so that sums can be subtracted without error; null, NaN and infinite ones are counted.
    """
    x = F.col(value).cast("double")
    finite = F.abs(x) < float("inf")
    size = F.when(finite & (x != 0), F.abs(x))
    other = {"valid": x.isNotNull(), "nan": F.isnan(x), "up": x == float("inf"), "down": x == -float("inf")}
    seen = rows.agg(F.max(size).alias("most"), F.min(size).alias("least"), F.bool_and(F.when(finite, F.rint(x) == x)).alias("whole"), *(F.bool_or(c).alias(k) for k, c in other.items())).first()
    first = math.frexp(seen.most or 0.5)[1]
    last = 0 if seen.whole or seen.most is None else max(math.frexp(seen.least)[1] - 53, -1074)
    tops = range(max(first, last + 1), last, -LIMB)
    ends = [max(top - LIMB, last) for top in tops]  # limb i has the bits from tops[i] down to ends[i]
    columns = {f"__limb{i}": F.when(finite, (x if i == 0 else x % math.ldexp(1.0, top)) / math.ldexp(1.0, end)).cast("long") for i, (top, end) in enumerate(zip(tops, ends))}
    columns |= {f"__{k}": c.cast("long") for k, c in other.items() if k == "valid" or seen[k]}

    def total(of: Callable[[str], Column]) -> Column:
        n = {k: of(f"__{k}") if f"__{k}" in columns else F.lit(0) for k in other}
        out = F.lit(0.0)
        for i, end in reversed(list(enumerate(ends))):
            out = out + of(f"__limb{i}").cast("double") * math.ldexp(1.0, end)
        both = (n["up"] > 0) & (n["down"] > 0)
        out = F.when((n["nan"] > 0) | both, float("nan")).when(n["up"] > 0, float("inf")).when(n["down"] > 0, -float("inf")).otherwise(out)
        return F.when(n["valid"] > 0, out)

    return columns, total


def range_totals(peaks: DataFrame, targets: DataFrame, value: str | None = None, salt: int = 1, width: float = S.MZ_WIDTH, parts: int = 64) -> DataFrame:
    """targets(lo, hi, ...) with n_peaks, the number of peaks(mz, ...) with lo <= mz <= hi, and `total`, the sum of
    their `value`; targets without peaks are left out, as by a join.

    The pairs of `range_join` in sums, without making them: these grow as peaks times targets where targets overlap,
    while here each distinct m/z and each distinct bound is one row. Rows are dealt into `parts` stretches of m/z and
    summed up in order; a target has what is summed up to its upper bound less what is below its lower one. Sums of
    values are exact until they are rounded. With salt > 1 the m/z of each stretch are dealt over so many parts, and
    bounds are copied to each. NaN is above all numbers and equal to itself, as in SQL.
    """
    ok = targets.where("lo <= hi")
    lo, hi, n_targets = ok.agg(F.min("lo"), F.max("hi"), F.count("*")).first()
    inside = _between(peaks, *((lo, hi) if n_targets else (1.0, 0.0)), width)
    columns, total = _exact(inside, value) if value else ({}, None)
    columns = {"__n": F.lit(1).cast("long")} | columns
    bounds = ok.select(F.col("lo").alias("__v"), F.lit(0).alias("__side")).unionByName(ok.select(F.col("hi").alias("__v"), F.lit(2).alias("__side")))

    def sample(column: DataFrame, n: int) -> list[float]:
        return [r[0] for r in column.sample(min(1.0, 100 * parts / max(n, 1)), 11).collect() if not math.isnan(r[0])]

    # Cuts are only for even stretches; bounds and peaks may lie in different places.
    cuts = order.cuts_of(sample(inside.select("mz"), inside.count()) + sample(bounds.select("__v"), 2 * n_targets), parts)
    part = order.stretch(F.col("__v"), cuts).alias("__p")
    mz = inside.select(F.col("mz").alias("__v"), *(c.alias(k) for k, c in columns.items()))
    sums = [F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in columns]
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each stretch
    every = ok.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("__p"))
    base = every.join(mz.groupBy(part).agg(*sums), "__p", "left").select("__p", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in columns))

    each = mz.groupBy("__v").agg(*sums).withColumns({"__side": F.lit(1), "__salt": F.pmod(F.xxhash64("__v"), F.lit(salt)).cast("int")})
    ends = bounds.distinct().withColumns({k: F.lit(0).cast("long") for k in columns} | {"__salt": F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))})
    # At the same m/z lower bounds come before peaks, upper ones behind.
    running = Window.partitionBy("__p", "__salt").orderBy("__v", "__side").rowsBetween(Window.unboundedPreceding, 0)
    at = each.unionByName(ends).withColumn("__p", part).select("__v", "__side", "__p", *(F.sum(k).over(running).alias(k) for k in columns)).where("__side <> 1")
    if salt > 1:
        at = at.groupBy("__v", "__side", "__p").agg(*(F.sum(k).alias(k) for k in columns))
    at = at.join(F.broadcast(base), "__p").select("__v", "__side", *((F.col(k) + F.col(f"{k}_before")).alias(k) for k in columns))

    def side(n: int, bound: str) -> DataFrame:
        return at.where(F.col("__side") == n).select(F.col("__v").alias(bound), *(F.col(k).alias(f"{k}_{bound}") for k in columns))

    out = ok.join(side(0, "lo"), "lo").join(side(2, "hi"), "hi")
    less = lambda k: F.col(f"{k}_hi") - F.col(f"{k}_lo")
    return out.where(less("__n") > 0).select(*targets.columns, less("__n").alias("n_peaks"), *([total(less).alias("total")] if value else []))


def nearest_before(left: DataFrame, right: DataFrame, by: str, time: str, value: str, out: str) -> DataFrame:
    """left with the `value` of the last row of right at or before its time, within the same `by`: an as-of join.

    Both sides go through one sort by key and time, and the last value is carried on; equal times match.
    """
    rows = left.select(F.struct("*").alias("row"), F.col(by).alias("k"), F.col(time).alias("t"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(1).alias("side"))
    rows = rows.unionByName(right.select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col(by).alias("k"), F.col(time).alias("t"), F.col(value).alias("v"), F.lit(0).alias("side")))
    w = Window.partitionBy("k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last("v", ignorenulls=True).over(w)).where("side = 1").select("row.*", out)
