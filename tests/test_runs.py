import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectraframe import files
from spectraframe import schema as S
from spectraframe.functions import arrays as A
from spectraframe.functions import scalar as fn
from spectraframe.operators import order, planning, rangejoin, scans
from spectraframe.sinks import mzml as out
from spectraframe.sinks import parquet
from spectraframe.sources import mzml
from spectraframe.streaming import scans as streaming

@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(width=32, allow_nan=False), max_size=30), st.sampled_from([1, 2]), st.booleans())
def test_array_text_round_trips(values, dtype, compress):
    text = A.encode(values, dtype, compress)
    terms = ["MS:1000523" if dtype == 1 else "MS:1000521", "MS:1000574" if compress else "MS:1000576"]
    assert mzml.decode(text, terms).tolist() == values
    assert mzml.decode(text, terms, 3).tolist() == values[:3]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=67), st.sampled_from([2, 4, 8]))
def test_bytes_round_trip(data, stride):
    assert A.restore_bytes(A.transpose_bytes(data, stride), stride) == data
    whole = data[: len(data) // stride * stride]
    assert A.sum_bits(A.delta_bits(whole, stride), stride) == whole if stride > 2 else True


def test_half_precision(spark):
    bits = [0, 1, 0x3C00, -1024, 0x7C00, 0x7E00, 0x03FF]
    got = spark.createDataFrame([(bits,)], "b array<short>").select(A.half_to_double(F.col("b")).alias("x")).first().x
    want = np.array(bits, np.int16).view(np.float16).astype(float)
    assert np.array_equal(np.array(got, float), want, equal_nan=True)


def _run(spark):
    nan = float("nan")
    spectra = spark.createDataFrame([(1, 0, 1.0, 1), (1, 1, nan, 1), (1, 2, 3.0, 2), (1, 3, 4.0, 1), (1, 4, 2.0, 1)], "run_id long, spectrum_index long, rt double, ms_level int")
    rows = [(0, 0, 100.0, 1.0), (0, 1, 119.9, 2.0), (0, 2, 120.0, 5.0), (1, 0, 130.0, 7.0), (3, 0, 130.5, 1.0), (3, 1, 140.0, 9.0)]
    peaks = spark.createDataFrame(rows, "spectrum_index long, pos int, mz double, intensity double")
    return spectra, peaks.withColumn("mz_bin", fn.window_index(F.col("mz")))


def test_scans_keep_empty_and_drop_nan(spark):
    spectra, peaks = _run(spark)
    got = {r.spectrum_index: r for r in scans.scans_in(spectra, peaks, scans.Range(120, 135), scans.Range(0, 10)).collect()}
    assert set(got) == {0, 3} and got[0].mz == [120.0] and got[3].intensity == [1.0]
    empty = scans.scans_in(spectra, peaks, scans.Range(500, 600)).collect()
    assert {r.spectrum_index for r in empty} == {0, 1, 3} and all(r.mz == [] for r in empty)
    assert scans.scans_in(spectra, peaks, scans.Range(120, 135), scans.Range(10, 0)).count() == 0
    kept = planning.extracted_ion_blocks(spectra, peaks, scans.Range(120, 135), scans.Range(0, 2), per_block=1).collect()
    assert {r.block for r in kept} == {0, 1}
    for r in (scans.Range(2, 1), scans.Range(math.nan, 1), scans.Range(0, math.inf)):
        with pytest.raises(scans.BadRange):
            scans.peaks_in(peaks, r)
    with pytest.raises(S.OutOfRange):
        scans.nth_scan(spectra, 6)


def test_order_checks(spark):
    spectra, peaks = _run(spark)
    assert [r.spectrum_index for r in order.rt_order_violations(spectra).collect()] == [4]
    assert order.rt_ascending(spectra).first().ascending is False
    bad = peaks.withColumn("mz", F.when(F.col("pos") == 1, F.lit(1.0)).otherwise(F.col("mz")))
    assert {r.spectrum_index for r in order.mz_order_violations(bad).collect()} == {0, 3}
    got = spark.createDataFrame([([1.0, 2.0, 2.0],), ([2.0, 1.0],), ([],), ([1.0, float("nan"), 0.5],)], "a array<double>").select(order.sorted_array(F.col("a")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, True, True]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 8)), max_size=15), st.integers(0, 5))
def test_merged_ranges(spark, ranges, gap):
    df = spark.createDataFrame([(1, a, n) for a, n in ranges], "run_id int, offset long, length long")
    got = sorted((r.offset, r.length) for r in planning.merge_ranges(df, gap, ["run_id"]).collect())
    want: list[list[int]] = []
    for a, n in sorted(ranges):
        if n and want and a <= want[-1][1] + gap:
            want[-1][1] = max(want[-1][1], a + n)
        elif n:
            want.append([a, a + n])
    assert got == [(a, b - a) for a, b in want]


def test_range_join_equals_nested_loop(spark):
    _, peaks = _run(spark)
    targets = spark.createDataFrame([(1, 119.0, 131.0), (2, 5.0, 1.0), (3, -5.0, 1000.0), (4, float("nan"), 3.0), (5, 130.5, 130.5)], "target_id int, lo double, hi double")
    pick = lambda df: sorted((r.target_id, r.mz) for r in df.collect())
    want = pick(peaks.join(targets, (F.col("mz") >= F.col("lo")) & (F.col("mz") <= F.col("hi")) & ~F.isnan("lo")))
    assert pick(rangejoin.range_join(peaks, targets)) == want == pick(rangejoin.range_join(peaks, targets, salt=3))
    assert "NestedLoop" not in rangejoin.range_join(peaks, targets)._jdf.queryExecution().toString()


def test_accessions(spark):
    texts = ["MS:1000514", "NCIT:C123", "no-colon", None, "MS:99999999999", "UO:0000031", "a:b:7x8", ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fn.accession_tail(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [1000514, 123, 0, 0, 0, 31, 78, 0]


def test_value_kinds(spark):
    texts = [None, "", "1", "1.5", "01.5", "1.50", "-0.25", "1e5", "x", "445.347"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fn.value_kind(F.col("t")).alias("k")).collect()
    assert [r.k for r in got] == [2, 2, 1, 0, 1, 1, 0, 1, 1, 0]


def test_store_round_trip_and_checks(spark, tmp_path):
    spectra, peaks = _run(spark)
    with pytest.raises(S.Malformed):
        parquet.write_run(str(tmp_path / "bad"), spectra, peaks)
    good = spectra.where("spectrum_index < 4")
    parquet.write_run(str(tmp_path / "run"), good, peaks)
    s, p, meta = parquet.read_run(spark, str(tmp_path / "run"))
    assert s.count() == 4 and p.count() == 6 and meta["mz_width"] == 20.0
    plan = scans.peaks_in(p, scans.Range(120, 135))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "mz_bin" in plan.split("PushedFilters")[1]


def test_files_and_counters(spark, tmp_path):
    for name in ("a/one.mzML", "b/TWO.MZML", "b/notes.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
    assert [r.name for r in files.discover(spark, str(tmp_path)).collect()] == ["one.mzML", "TWO.MZML"]
    assert [r.name for r in files.discover(spark, str(tmp_path), pattern="tw&o|zzz").collect()] == ["TWO.MZML"]
    with pytest.raises(ValueError):
        files.discover(spark, str(tmp_path), pattern="a", regex="b")
    got = {r.status: r.n for r in files.counters(spark.createDataFrame([("ok",), ("ok",), ("failed",)], "status string")).collect()}
    assert got == {"ok": 2, "failed": 1, "skipped": 0, "fixed": 0}


def test_stream_finds_falling_rt(spark, tmp_path):
    spectra, _ = _run(spark)
    src = str(tmp_path / "in")
    spectra.where("spectrum_index < 3").coalesce(1).write.parquet(src)
    spectra.where("spectrum_index >= 3").coalesce(1).write.mode("append").parquet(src)
    stream = streaming.scan_stream(spark, src, spectra.schema, files_per_trigger=1)
    q = streaming.rt_violations(stream).writeStream.format("memory").queryName("falls").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.spectrum_index, r.previous_rt) for r in spark.table("falls").collect()] == [(4, 4.0)]


def test_plans(spark):
    """Plans keep what was meant: bounded ranks before the shuffle, no nested loops, no window over one partition."""
    spectra, peaks = _run(spark)
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text(scans.top_peaks(peaks, 2))
    counted = spectra.withColumn("n_peaks", F.when(F.col("spectrum_index") == 2, 0).otherwise(1))
    plan = text(scans.scans_in(counted, peaks, scans.Range(120, 135)))
    assert "LeftSemi" not in plan
    assert {r.spectrum_index for r in scans.scans_in(counted, peaks, scans.Range(120, 135)).collect()} == {0, 1, 3, 4}
    wide = spark.createDataFrame([(i, i / 10, i / 10 + 0.01) for i in range(50)] + [(99, 0.0, 400.0), (100, -math.inf, math.inf), (101, 5.0, 5.0)], "target_id int, lo double, hi double")
    pick = lambda df: sorted((r.target_id, r.mz) for r in df.collect())
    many = spark.range(3000).selectExpr("id / 250.0D AS mz").withColumn("mz_bin", fn.window_index(F.col("mz")))
    want = pick(many.join(wide, (F.col("mz") >= F.col("lo")) & (F.col("mz") <= F.col("hi"))))
    assert pick(rangejoin.range_join(many, wide)) == want == pick(rangejoin.range_join(many, wide, salt=2)) and len(want) > 6000
    assert rangejoin.range_join(many, wide.limit(0)).count() == 0


def test_global_ordinals_and_ranges(spark):
    rows = [(None, i) for i in range(5)] + [(i % 7, i) for i in range(300)] + [(3, 1000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = sorted((r.ordinal, r.a, r.b) for r in order.global_ordinals(df, ["a", "b"], parts=5).collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(a, b) for _, a, b in got] == want and [n for n, _, _ in got] == list(range(len(rows)))
    assert order.global_ordinals(df.limit(0), ["a", "b"]).count() == 0
    ranges = [(5, 10), (0, 3), (3, 1), (100, 0), (14, 1), (60, 1000), (70, 5), (2000, 1), (1061, 3), (1 << 40, 7)]
    for parts in (1, 3, 256):
        got = sorted((r.offset, r.length) for r in planning.merge_ranges(spark.createDataFrame(ranges, "offset long, length long"), 1, parts=parts).collect())
        assert got == [(0, 15), (60, 1004), (2000, 1), (1 << 40, 7)], (parts, got)
