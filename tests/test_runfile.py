import math

import numpy as np
import pytest

from spectraframe import schema as S
from spectraframe.sinks import runfile as W
from spectraframe.sources import runfile as R


def items(n=40, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = int(rng.integers(0, 300))
        mz = np.sort(rng.uniform(50, 400, k))
        arrays = [{"accession": S.MZ, "dtype": 1, "values": mz}, {"accession": S.INTENSITY, "dtype": 2, "values": rng.random(k).astype(np.float32)}]
        if i % 5 == 0:
            arrays.append({"accession": 1000786, "dtype": 6, "values": rng.integers(-5, 5, 7)})
        params = [{"accession": "MS:1000511", "value": "1"}, {"accession": "MS:1000504", "value": "445.347"}, {"accession": "UO:0000031", "value": ""}, {"accession": "MS:1000285", "value": "é text"}]
        out.append({"id": f"scan={i}", "rt": math.nan if i == 3 else float(i), "ms_level": 1 + i % 2, "polarity": i % 3, "rt_unit": 1, "arrays": arrays, "params": params})
    return out


CHROM = [{"id": "tic", "arrays": [{"accession": S.TIME, "dtype": 1, "values": np.array([0.0, -0.0, math.nan, math.inf])}, {"accession": S.INTENSITY, "dtype": 1, "values": np.arange(4.0)}], "polarity": 1}]


@pytest.mark.parametrize("level,size", [(0, 1 << 20), (12, 1 << 20), (3, 700)])
def test_round_trip(tmp_path, level, size):
    path, run = str(tmp_path / "a.run"), items()
    W.write(path, run, CHROM, level=level, block_size=size)
    f = R.RunFile.open(path)
    assert f.header.counts["n_spectra"] == 40 and f.header.counts["n_chromatograms"] == 1 and f.header.level == level
    for i, s in enumerate(run):
        got = {a["accession"]: a for a in f.arrays(i)}
        for a in s["arrays"]:
            assert got[a["accession"]]["dtype"] == a["dtype"] and np.array_equal(got[a["accession"]]["values"], a["values"])
        assert (math.isnan(f.a1["rt"][i]) if i == 3 else f.a1["rt"][i] == i) and f.a1["ms_level"][i] == s["ms_level"] and math.isnan(f.a1["base_peak_mz"][i])
    assert f.values(0, 4711).tolist() == []
    chrom = f.values(0, "time", True)
    assert chrom.tobytes() == CHROM[0]["arrays"][0]["values"].tobytes()
    rows = [r for r in f.metadata("C") if r[0] == 7]
    assert [(r[5], r[6], r[9], r[10], r[11]) for r in rows[2:]] == [(0, 1000511, 1, None, "1"), (0, 1000504, 0, 445.347, None), (1, 31, 2, None, None), (0, 1000285, 1, None, "é text")]
    assert rows[1][11] == "scan=7"
    assert all(ok for _, _, ok in R.check(path))
    with pytest.raises(S.OutOfRange):
        f.arrays(40)


def test_windows_find_all_points(tmp_path):
    path, run = str(tmp_path / "a.run"), items()
    W.write(path, run, level=1)
    f = R.RunFile.open(path)
    w = f.windows()
    for b in range(len(w["starts"]) - 1):
        for e in range(w["starts"][b], w["starts"][b + 1]):
            x, y = f.segment("spectra", f.a3[w["x_address"][e]]), f.segment("spectra", f.a3[w["y_address"][e]])
            if f.a2[w["item"][e]]["count"] > 3 or b:
                assert len(x) == len(y)
            own = run[w["item"][e]]["arrays"][0]["values"]
            if w["item"][e] % 5:
                assert np.array_equal(x, own[np.floor(own / 20) == b])


def test_damage_is_found(tmp_path):
    path = str(tmp_path / "a.run")
    W.write(path, items(5))
    good = open(path, "rb").read()
    f = R.RunFile.of_bytes(good)
    start = f.header.sections["spectra"][0]
    places = {0: S.Malformed, 9: S.Unsupported, 20: S.BadChecksum, 500: S.Malformed, f.header.sections["A1"][0]: S.BadChecksum, len(good) - 3: S.Malformed}
    for at, error in places.items():
        with pytest.raises(error):
            R.RunFile.of_bytes(good[:at] + bytes([good[at] ^ 0x55]) + good[at + 1 :])
    bad = R.RunFile.of_bytes(good[:start] + bytes([good[start] ^ 1]) + good[start + 1 :])
    with pytest.raises(S.BadChecksum):
        [bad.arrays(i) for i in range(5)]
    with pytest.raises(S.Malformed):
        R.RunFile.of_bytes(good[:-1])
    with pytest.raises(S.Malformed):
        R.unpack(b"x", 1 << 31, R.ZSTD)


def test_writer_refuses():
    import io

    mz = lambda v: [{"accession": S.MZ, "dtype": 1, "values": v}, {"accession": S.INTENSITY, "dtype": 1, "values": [1.0] * len(v)}]
    for bad in ([{"arrays": mz([2.0, 1.0])}], [{"rt": 2.0}, {"rt": 1.0}], [{"arrays": mz([3e9])}]):
        w = W.Writer(io.BytesIO(), mz_width=1)
        with pytest.raises(S.Malformed):
            for s in bad:
                w.spectrum(s)
    w = W.Writer(io.BytesIO())
    w.chromatogram({"id": "c"})
    with pytest.raises(S.Malformed):
        w.spectrum({"id": "s"})


def test_numbers_in_text():
    assert [W.is_number(t) for t in ("1.5", "1", "0.1", "1e5", "01.5", "-2.25", "1.50", "nan", ".5")] == [True, False, True, False, False, True, False, False, False]


def test_data_source(spark, tmp_path):
    run = items(30)
    for name in ("a", "b"):
        W.write(str(tmp_path / f"{name}.run"), run, CHROM)
    spark.dataSource.register(R.RunFileSource)
    load = lambda table: spark.read.format("runfile").option("table", table).option("itemsPerPartition", 7).load(str(tmp_path))
    assert load("spectra").count() == 60 and load("chromatograms").count() == 2
    rows = load("arrays").where("spectrum_index = 12").collect()
    assert len(rows) == 2 and rows[0].arrays[0]["values"] == run[12]["arrays"][0]["values"].tolist()
    assert load("blocks").where("container = 'spectra'").count() > 2 and load("windows").count() > 0
    assert load("sections").where("section = 'A1' AND offset % 8 = 0").count() == 2
    assert R.read_files(spark, str(tmp_path / "a.run"), "metadata").where("text = 'scan=7'").count() == 1
    got = R.read_files(spark, str(tmp_path), "arrays").where("spectrum_index = 12").first()
    assert got.arrays[0]["values"] == run[12]["arrays"][0]["values"].tolist()


def test_version_change(tmp_path):
    path = str(tmp_path / "a.run")
    W.write(path, items(3))
    assert W.set_version(path, 0) and R.RunFile.open(path).header.version == 0 and not W.set_version(path, 0)
    with pytest.raises(S.Unsupported):
        W.set_version(path, 2)


def test_ranges_and_plans(tmp_path):
    path, run = str(tmp_path / "a.run"), items(60)
    W.write(path, run, CHROM, level=1, block_size=2000)
    f = R.RunFile.open(path)
    for i in (1, 2, 5, 7):
        mz, y = run[i]["arrays"][0]["values"], run[i]["arrays"][1]["values"]
        for lo, hi in ((120.0, 130.0), (100.0, 149.999), (130.5, 130.5), (500.0, 600.0), (0.0, 50.0)):
            a, b = f.in_range(i, lo, hi)
            keep = (mz >= lo) & (mz <= hi)
            assert np.array_equal(a, mz[keep]) and np.array_equal(b, y[keep].astype(float))
        every, some = f.byte_ranges(i), f.byte_ranges(i, (120.0, 130.0))
        assert set(some) <= set(every) and (len(mz) == 0 or every)
        assert f.byte_ranges(i, arrays=(4711,)) == []
    # What a plan names is enough to read by.
    reads = []
    raw = open(path, "rb").read()
    g = R.RunFile(lambda o, n: reads.append((o, n)) or raw[o : o + n], len(raw))
    planned = g.extracted_ion_ranges((120.0, 130.0), (0.0, 20.0))
    assert planned == sorted(planned) and f.extracted_ion_ranges((120.0, 130.0), None, 1 << 30)[0][1] >= sum(n for _, n in planned)
    reads.clear()
    w = g.windows()
    reads.clear()
    e = int(w["starts"][6])
    if g.a1["rt"][w["item"][e]] <= 20:
        g.segment("spectra", g.a3[w["x_address"][e]])
        assert all(any(o <= a and a + n <= o + m for o, m in planned) for a, n in reads)
    o, n = f.metadata_range(7)
    c = f.header.sections["C"]
    assert c[0] <= o and o + n <= c[0] + c[1]
    assert list(f.global_metadata()) == []
    touched = f.touched()
    assert touched[0] == ("header", 0, 1024) and touched[-1][0] == "trailer"
    for bad in ((2.0, 1.0), (math.nan, 1.0), (0.0, math.inf)):
        with pytest.raises(S.BadRange):
            f.extracted_ion_ranges(bad)
    assert R.merge([(0, 10), (10, 5), (55, 5), (101, 1)], 40) == [(0, 60), (101, 1)]


def test_checks_name_what_is_wrong(tmp_path):
    path = str(tmp_path / "a.run")
    W.write(path, items(20), CHROM)
    good = open(path, "rb").read()
    labels = [label for _, label, ok in R.check(path) if ok]
    assert len(labels) == len(R.check(path)) >= 31
    header = R.Header.parse(good[:1024])
    for at, label in ((0, "signature"), (8, "byte order"), (14, "reserved bytes are zero"), (1000, "header checksum"), (header.sections["A1"][0], "A1 checksum"), (header.sections["spectra"][0], "spectra blocks"), (len(good) - 2, "trailer")):
        open(path, "wb").write(good[:at] + bytes([good[at] ^ 0x55]) + good[at + 1 :])
        assert label in [x for _, x, ok in R.check(path) if not ok]
    open(path, "wb").write(good[:500])
    assert not any(ok for _, label, ok in R.check(path) if label in ("header is whole", "trailer", "file size", "spectrum arrays"))


def test_range_reads_take_few_blocks(tmp_path):
    path, run = str(tmp_path / "a.run"), items(30)
    W.write(path, run, level=1, block_size=2000)
    f = R.RunFile.open(path)
    read = []
    inner = f._block
    f._block = lambda name, number, stride: (read.append(number), inner(name, number, stride))[1]
    for i, s in enumerate(run):
        mz, y = (a["values"] for a in s["arrays"][:2])
        got = f.in_range(i, 120.0, 139.5)
        keep = (mz >= 120) & (mz <= 139.5)
        assert np.array_equal(got[0], mz[keep]) and np.allclose(got[1], y[keep])
    assert len(set(read)) < 0.4 * len(f.blocks["spectra"])
    assert [r[11] for r in f.metadata_of(7)][1] == "scan=7" and f.element(7)["cvParam"][0]["_accession"] == "MS:1000511"
    assert {"A0", "B0"} & {x[0] for x in f.touched()} == {"A0"}
    with pytest.raises(S.OutOfRange):
        f.in_range(30, 0, 1)


def test_open_blocks_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(W, "PENDING", 5000)
    path, run = str(tmp_path / "a.run"), items(40)
    W.write(path, run)
    f = R.RunFile.open(path)
    assert all(np.array_equal(f.values(i, "mz"), s["arrays"][0]["values"]) for i, s in enumerate(run)) and len(f.blocks["spectra"]) > 60
    assert all(ok for _, _, ok in R.check(path))


def test_orphans_are_swept(tmp_path):
    path = str(tmp_path / "a.run")
    (tmp_path / "a.run.999999999.tmp").write_text("x")
    (tmp_path / "a.run.1.tmp").write_text("x")
    W.write(path, items(2))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a.run", "a.run.1.tmp"]


def test_producers(spark, tmp_path):
    from spectraframe.sources import memory as M

    run = M.Memory([M.spectrum("a", [1.0, 2.0], [3.0, 4.0], rt=1.0, ms_level=1), M.spectrum("b", [], [])], [M.chromatogram("tic", [0.0], [7.0])], {"run": {"_id": "r"}})
    path = str(tmp_path / "m.run")
    M.write(run, path)
    f = R.RunFile.open(path)
    assert f.values(0, "mz").tolist() == [1.0, 2.0] and f.values(0, "time", True).tolist() == [0.0] and dict(f.head())["run"] == {"_id": "r"}

    class Endless:
        """A producer that makes its items as they are asked for."""

        def head(self):
            return {}

        def spectra(self):
            return (M.spectrum(f"s{i}", [float(i)], [1.0], rt=float(i)) for i in range(1000))

        def chromatograms(self):
            return iter(())

    M.write(Endless(), path)
    assert R.RunFile.open(path).header.counts["n_spectra"] == 1000
    spectra, chroms = M.frames(spark, run)
    assert [(r.id, len(r.arrays)) for r in spectra.orderBy("spectrum_index").collect()] == [("a", 2), ("b", 2)] and chroms.count() == 1


def test_counts_must_fit(tmp_path):
    path = str(tmp_path / "a.run")
    W.write(path, items(5))
    good = open(path, "rb").read()
    for field, value in (("spectrum_blocks", 1 << 40), ("C_groups", 9), ("n_spectra", 1 << 20)):
        h = R.Header.parse(good[:1024])
        h.counts[field] = value
        with pytest.raises(S.Malformed):
            R.RunFile.of_bytes(h.pack() + good[1024:])
