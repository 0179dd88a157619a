"""Documents in, through all stores, and out again, compared element by element."""

import hashlib
import itertools
import json
import re
from xml.etree import ElementTree

import numpy as np
import pytest
from documents import TYPES, array, arrays, cv, document, full, legacy
from pyspark.sql import functions as F

from spectraframe import cli, files
from spectraframe import schema as S
from spectraframe.functions import elements as E
from spectraframe.sinks import mzml as out
from spectraframe.sources import mzml, runfile


def save(path, text, charset="latin-1"):
    path.write_bytes(text.encode(charset))
    return str(path)


def tree(x):
    """An element as (tag, attributes, children), without what depends on the text of arrays and the order of attributes."""
    tag = x.tag.rpartition("}")[2]
    skip = {"encodedLength", "count", "arrayLength"}
    kids = [tree(c) for c in x if c.tag.rpartition("}")[2] not in ("binary", "indexList", "indexListOffset", "fileChecksum")]
    if tag == "binaryDataArray":  # terms of type and compression are those of the new text
        kids = [k for k in kids if k[1].get("accession") not in (*mzml.TYPES, "MS:1000574", "MS:1000576")]
    return tag, {k: v for k, v in x.attrib.items() if "}" not in k and k not in skip}, kids


def parsed(text):
    root = ElementTree.fromstring(text.encode() if "encoding=\"utf-8\"" in text else text.encode("latin-1"))
    return next(x for x in root.iter() if x.tag.endswith("}mzML"))


def values(df, index="spectrum_index"):
    return [(r.id, [(a.accession, a.dtype, a["values"]) for a in r.arrays]) for r in df.orderBy(index).collect()]


def test_reads_everything(spark, tmp_path):
    path = save(tmp_path / "full.mzML", full())
    assert mzml.declared_charset(spark, path) == "ISO-8859-1"
    rows = mzml.spectra(spark, path).orderBy("spectrum_index").collect()
    assert [(r.spectrum_index, r.id, r.ms_level, r.polarity, len(r.arrays)) for r in rows] == [(0, "scan=19", 1, 0, 2), (1, "scan=20", 2, 2, 3), (2, "scan=21", 1, 0, 0), (3, "sample=1 cycle=22", 1, 0, 2)]
    assert rows[0].rt == 5.8905 and rows[0].rt_unit == S.UNIT_MINUTE and rows[3].rt_unit == S.UNIT_SECOND and rows[1].selected_ion_mz == 445.34 and rows[0].total_ion_current == 120
    assert [a.dtype for a in rows[1].arrays] == [1, 1, 4] and rows[1].arrays[2]["values"] == list(range(10))
    assert sum(rows[0].arrays[0]["values"]) == 105 and sum(rows[0].arrays[1]["values"]) == 120
    chroms = mzml.chromatograms(spark, path).orderBy("chromatogram_index").collect()
    assert [(c.id, len(c.arrays[0]["values"])) for c in chroms] == [("tic", 15), ("sic", 10)] and len(chroms[1].precursor_window) == 2
    head = {r.tag: json.loads(r.element) for r in mzml.heads(spark, path).collect()}
    assert head["run"]["_startTimeStamp"] == "2007-06-27T15:23:45.00035" and head["run"]["cvParam"][0]["_accession"] == "MS:1000857" and head["spectrumList"]["_defaultDataProcessingRef"] == "dp"
    assert head["fileDescription"]["contact"][0]["cvParam"][0]["_value"] == "José Ñandú"
    assert [(t.mz, t.lo, t.hi) for t in mzml.targets(spark, path).orderBy("target_no").collect()] == [(1000.0, 1000.0, 1000.0), (1200.5, 1200.0, 1202.0)]
    loose = full().replace('<targetList count="2">', "<gone>", 1)
    a, b = loose.index("<gone>"), loose.index("</targetList>") + len("</targetList>")
    listed = "".join(cv(f"MS:{n}", "x", v) for n, v in ((1000827, 5), (1001225, "one"), (1000502, 4), (1000747, 7), (1000827, 9)))
    other = save(tmp_path / "loose.mzML", loose[:a] + listed + loose[b:])
    assert [(t.name, t.mz, t.lo, t.hi) for t in mzml.targets(spark, other).orderBy("target_no").collect()] == [("one", 5.0, 4.0, 7.0), (None, 9.0, 9.0, 9.0)]
    assert mzml.dangling_references(spark, path).count() == 0
    bad = save(tmp_path / "bad.mzML", full().replace('<precursor spectrumRef="scan=19">', '<precursor spectrumRef="scan=99">'))
    assert [(r.kind, r.ref) for r in mzml.dangling_references(spark, bad).collect()] == [("spectrum", "scan=99")]


def test_utf8_is_found_out(spark, tmp_path):
    path = save(tmp_path / "u.mzML", full().replace("ISO-8859-1", "utf-8"), "utf-8")
    head = {r.tag: json.loads(r.element) for r in mzml.heads(spark, path).collect()}
    assert head["fileDescription"]["contact"][0]["cvParam"][0]["_value"] == "José Ñandú"


def test_legacy_names(spark, tmp_path):
    path = save(tmp_path / "old.mzML", legacy())
    rows = mzml.spectra(spark, path).orderBy("spectrum_index").collect()
    assert [(r.spectrum_index, r.id, r.ms_level, r.scan_number) for r in rows] == [(0, "S19", 1, 19), (1, "S20", 2, 20)]
    assert rows[0].rt == 5.5 and rows[1].selected_ion_mz == 445.34 and [a.dtype for a in rows[0].arrays] == [1, 2]
    now = E.loaded("spectrum", rows[1].element)
    assert "spectrumDescription" not in now and now["precursorList"][0]["precursor"][0]["selectedIonList"][0]["selectedIon"][0]["cvParam"][0]["_cvRef"] == "MS"
    assert now["scanList"][0]["scan"][0]["_instrumentConfigurationRef"] == "LTQ" and [p["_value"] for p in now["cvParam"]] == ["2"]
    head = out.head_values(*zip(*[(r.tag, r.element) for r in mzml.heads(spark, path).collect()]))
    assert head["cvList"]["cv"][0]["_id"] == "MS" and head["softwareList"]["software"][0]["_version"] == "1.0" and head["dataProcessingList"]["dataProcessing"][0]["processingMethod"][0]["_softwareRef"] == "sw"
    assert head["instrumentConfigurationList"]["instrumentConfiguration"][0]["softwareRef"] == [{"_ref": "sw"}] and head["fileDescription"]["sourceFileList"][0]["sourceFile"][0]["_name"] == "old.raw"


@pytest.mark.parametrize("compress", [False, True])
def test_written_documents_hold_the_same(spark, tmp_path, compress):
    path = save(tmp_path / "full.mzML", full())
    doc = out.documents(mzml.spectra(spark, path), mzml.chromatograms(spark, path), compress=compress, heads=mzml.heads(spark, path)).first().document
    want, got = tree(parsed(full())), tree(parsed(doc))
    assert want[1]["version"] == "1.1.0"
    # The run's name is that of the file here, as rows are named by it.
    named = lambda t: (t[0], {k: v for k, v in t[1].items() if not (t[0] == "run" and k == "id")}, [named(c) for c in t[2]])
    assert named(got) == named(want)
    again = save(tmp_path / "again.mzML", doc, "utf-8")
    assert values(mzml.spectra(spark, again)) == values(mzml.spectra(spark, path))
    assert values(mzml.chromatograms(spark, again), "chromatogram_index") == values(mzml.chromatograms(spark, path), "chromatogram_index")
    raw = doc.encode()
    offsets = mzml.index(spark, again).collect()
    assert len(offsets) == 6 and all(raw[r.offset :].startswith(f"<{r.index_name} ".encode()) for r in offsets)
    tail = mzml.index_tail(spark, again).first()
    cut = raw.index(b"<fileChecksum>") + len(b"<fileChecksum>")
    assert raw[tail.index_list_offset :].startswith(b"<indexList ") and tail.file_checksum == hashlib.sha1(raw[:cut]).hexdigest()


def plain(x):
    """A value without names and units' names, which stored rows do not hold."""
    if isinstance(x, list):
        return [plain(y) for y in x]
    if not isinstance(x, dict):
        return x
    return {k: plain(v) for k, v in x.items() if k not in ("_name", "_unitName", "_count", "_encodedLength", "_cvRef", "_unitCvRef") or (k == "_name" and "_accession" not in x)}


def test_rows_of_elements_and_back(spark, tmp_path):
    for text in (full(), legacy()):
        path = save(tmp_path / "x.mzML", text)
        found = [("spectrum", r.element) for r in mzml.spectra(spark, path).collect()] + [(E.ELEMENTS_NOW.get(r.tag, r.tag), r.element) for r in mzml.heads(spark, path).collect() if r.tag != "mzML"]
        for tag, element in found:
            value = E.loaded(tag, element)
            ((t, again),) = E.assembled(E.rows(tag, value, 0, 1))
            keep = lambda x: {k: v for k, v in x.items()}
            assert t == tag
            a, b = (json.loads(json.dumps(plain(keep(v)), sort_keys=True)) for v in (again, value))
            dropped = {"_methodOfCombination", "_number"}  # attributes that stored rows have no number for
            strip = lambda x: {k: strip(v) for k, v in x.items() if k not in dropped} if isinstance(x, dict) else [strip(v) for v in x] if isinstance(x, list) else x  # noqa: E731, B023
            assert strip(a) == strip(b), tag


def test_through_all_stores(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    path = save(source / "full.mzML", full().replace('name="scan start time" value="420"', 'name="scan start time" value="6.5"'))
    native, runs, again, back = (str(tmp_path / x) for x in ("native", "runs", "again", "back"))
    assert files.convert(spark, path, native) == "to_parquet"
    assert files.convert(spark, native, runs, "to_runfile") == "to_runfile"
    (stored,) = (tmp_path / "runs").glob("*.run")
    assert cli.main(["check", str(stored)]) == 0 and cli.main(["check", native]) == 0
    f = runfile.RunFile.open(str(stored))
    assert f.header.counts["n_spectra"] == 4 and f.header.counts["n_chromatograms"] == 2
    head = dict(f.head())
    assert {"fileDescription", "run", "cvList", "softwareList", "scanSettingsList", "instrumentConfigurationList", "dataProcessingList", "sampleList", "referenceableParamGroupList"} == set(head)
    assert files.convert(spark, str(stored), again) == "to_parquet"
    for name, index in (("arrays", "spectrum_index"), ("chromatograms", "chromatogram_index")):
        first, second = (spark.read.parquet(f"{x}/{name}") for x in (native, again))
        assert values(first, index) == values(second, index)
        tag = index.removesuffix("_index")
        pairs = zip(*([r.element for r in x.orderBy(index).collect()] for x in (first, second)))
        for a, b in pairs:
            a, b = plain(E.loaded(tag, a)), plain(E.loaded(tag, b))
            assert {k: v for k, v in a.items() if k != "_defaultArrayLength"} == {k: v for k, v in b.items() if k != "_defaultArrayLength"}
    assert files.convert(spark, again, back, "to_mzml") == "to_mzml"
    assert values(mzml.spectra(spark, f"{back}/*")) == values(spark.read.parquet(f"{native}/arrays"))
    assert mzml.dangling_references(spark, f"{back}/*").count() == 0


def test_types_of_arrays():
    code = {"MS:1000523": 1, "MS:1000521": 2, "MS:1000520": 3, "MS:1000518": 4, "MS:1000519": 5, "MS:1000522": 6}
    for a, n in code.items():
        assert mzml.element_type([a, "MS:1000574"]) == n
    want = {frozenset(x): y for x, y in [
        ((1, 2), 1), ((1, 3), 1), ((1, 4), 4), ((1, 5), 5), ((1, 6), 1), ((2, 3), 2), ((2, 4), 4), ((2, 5), 5), ((2, 6), 2), ((3, 4), 3), ((3, 5), 3), ((3, 6), 3), ((4, 5), 5), ((4, 6), 6), ((5, 6), 6),
    ]}
    for a, b in itertools.combinations(code, 2):
        assert mzml.element_type([a, b]) == mzml.element_type([b, a]) == want[frozenset((code[a], code[b]))], (a, b)
    assert mzml.element_type([]) == 1


def test_arrays_of_all_types(spark, tmp_path):
    each = [array("mz" if i == 0 else "other", [1, 2, 3, 100], t, packed=i % 2 == 1) for i, t in enumerate(TYPES)]
    text = document("", '<run id="r">', [f'<spectrum index="0" id="a" defaultArrayLength="4">{cv("MS:1000511", "ms level", 1)}{arrays(*each)}</spectrum>'])
    path = save(tmp_path / "t.mzML", text)
    (r,) = mzml.spectra(spark, path).collect()
    assert [a.dtype for a in r.arrays] == [1, 2, 3, 4, 5, 6] and all(a["values"] == [1, 2, 3, 100] for a in r.arrays)
    again = save(tmp_path / "t2.mzML", out.documents(mzml.spectra(spark, path)).first().document, "utf-8")
    assert values(mzml.spectra(spark, again)) == values(mzml.spectra(spark, path))


def test_numbers_without_an_index(spark, tmp_path):
    """Elements without an index are numbered in their file's order, in split files too."""
    many = "".join(f'<spectrum id="s{i}" defaultArrayLength="0">{cv("MS:1000511", "ms level", 1)}</spectrum>\n' for i in range(900))
    for name in ("a", "b"):
        save(tmp_path / f"{name}.mzML", document("", '<run id="r">', [many]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)
    try:
        df = mzml.spectra(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        rows = df.select("source_path", "spectrum_index", "id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 1800 and all(r.id == f"s{r.spectrum_index}" for r in rows)


def test_streams_of_documents(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    save(source / "one.mzML", full())
    q = mzml.stream(spark, str(source)).select("id", "ms_level", "rt", F.size("arrays").alias("n")).writeStream.format("memory").queryName("documents").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.ms_level, r.n) for r in spark.table("documents").collect()) == [("sample=1 cycle=22", 1, 2), ("scan=19", 1, 2), ("scan=20", 2, 3), ("scan=21", 1, 0)]


def test_kinds_of_files(spark, tmp_path):
    from spectraframe.operators import planning
    from spectraframe.sinks import runfile as W

    path = save(tmp_path / "no_extension", full())
    W.write(str(tmp_path / "other"), [{"id": "a", "arrays": []}])
    assert files.kind_of(path, spark) == "mzml" and files.kind_of(str(tmp_path / "other"), spark) == "run" and files.kind_of(str(tmp_path), None) == "dataset"
    f = runfile.RunFile.open(str(tmp_path / "other"))
    with pytest.raises(S.Missing):
        f.windows()
    with pytest.raises(S.Missing):
        planning.require_windows(spark.range(1))
    with pytest.raises(S.Malformed):
        planning.require_windows(spark.sql("SELECT 'a' AS mz_bin"))


def test_broken_and_closed_elements(spark, tmp_path):
    path = save(tmp_path / "c.mzML", document("", '<run id="r">', ['<spectrum index="0" id="a" defaultArrayLength="0"/>', '<spectrum index="1" id="b"><cvParam accession="MS:1000511" name="ms level" value="2"/></spectrum>', '<spectrum index="2" id="c"/>']))
    assert [(r.spectrum_index, r.id, r.ms_level) for r in mzml.spectra(spark, path).orderBy("spectrum_index").collect()] == [(0, "a", 0), (1, "b", 2), (2, "c", 0)]
    assert mzml.truncated(spark, path).count() == 0
    broken = save(tmp_path / "d.mzML", full()[:6000])
    assert mzml.truncated(spark, broken).count() == 1
    with pytest.raises(Exception, match="(?i)malformed|MALFORMED"):
        mzml.spectra(spark, broken).collect()


def test_command_line(spark, tmp_path, capsys):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    text = full().replace('name="scan start time" value="420"', 'name="scan start time" value="6.5"')
    for name in ("one", "two"):
        save(source / f"{name}.mzML", text)
    save(source / "broken.mzML", full()[:6000])
    run = lambda *a: (cli.main(["convert", "-i", str(source), "-o", target, *a]), capsys.readouterr().out)
    code, said = run("--pattern", "one")
    assert code == 0 and "ok: 1" in said and not (tmp_path / "out/two").exists()
    code, said = run("--regex", "^(one|two)")
    assert code == 0 and "ok: 1" in said and "skipped: 1" in said
    code, said = run("--kind", "to_parquet", "--overwrite")
    assert code == 1 and "ok: 2" in said and "failed: 1" in said
    with pytest.raises(SystemExit):
        run("--pattern", "a", "--regex", "b")
    path = str(source / "one.mzML")
    capsys.readouterr()
    assert cli.main(["cat", path, "--chrom", "0"]) == 1 and cli.main(["cat", path, "--scan", "5"]) == 1
    assert cli.main(["cat", path, "--chrom", "2"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["id"] == "sic"
    assert cli.main(["cat", path, "--head"]) == 0 and '"run"' in capsys.readouterr().out
    runs = tmp_path / "runs"
    files.convert(spark, f"{target}/one", str(runs), "to_runfile")
    (stored,) = runs.glob("*.run")
    assert cli.main(["update", str(stored)]) == 0 and "as it was" in capsys.readouterr().out
    assert cli.main(["cat", str(stored), "--scan", "2"]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["id"] == "scan=20"


def test_illegal_characters_are_refused():
    with pytest.raises(S.Malformed):
        list(out.document("r\x01", iter(())))


def test_other_marks(tmp_path):
    from spectraframe.sinks import runfile as W

    path = str(tmp_path / "a.run")
    W.write(path, [{"id": "a", "arrays": []}])
    raw = open(path, "rb").read()
    header = bytearray(raw[:1024])
    header[:8] = b"OTHER\0\0\0"
    header[1020:1024] = __import__("zlib").crc32(bytes(header[:1020])).to_bytes(4, "little")
    other = bytes(header) + raw[1024:-8] + b"\0\0\0REHTO"
    with pytest.raises(S.Malformed):
        runfile.RunFile.of_bytes(other)
    assert runfile.RunFile.of_bytes(other, marks=(b"OTHER\0\0\0", b"\0\0\0REHTO")).header.counts["n_spectra"] == 1
    assert re.search(rb"SPFRUN", raw) and np.frombuffer(raw[:8], np.uint8).sum()
