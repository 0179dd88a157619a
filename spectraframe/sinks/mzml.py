"""Runs as indexed mzML 1.1 documents: one document for each run, with index offsets and a SHA-1 checksum."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import arrays as A
from ..functions import elements as E
from ..sources.mzml import TYPES, ZLIB

# Parameters of element types and compressions.
TYPE_TERMS = {
    1: ("MS:1000523", "64-bit float"), 2: ("MS:1000521", "32-bit float"), 3: ("MS:1000520", "16-bit float"), 4: ("MS:1000518", "16-bit integer"),
    5: ("MS:1000519", "32-bit integer"), 6: ("MS:1000522", "64-bit integer"),
}
AXIS_TERMS = {S.MZ: "m/z array", S.INTENSITY: "intensity array", S.TIME: "time array"}
PLAIN = "MS:1000576"
_ATTRIBUTES = (("cv_ref", "cvRef"), ("accession", "accession"), ("name", "name"), ("value", "value"), ("unit_cv_ref", "unitCvRef"), ("unit_accession", "unitAccession"), ("unit_name", "unitName"))
#: Elements of a head in the order of the document; those before the run.
_HEAD = ("cvList", "fileDescription", "referenceableParamGroupList", "sampleList", "softwareList", "scanSettingsList", "instrumentConfigurationList", "dataProcessingList")
_DEFAULTS = {
    "cvList": {"cv": [
        {"_id": "MS", "_fullName": "Proteomics Standards Initiative Mass Spectrometry Ontology", "_URI": "https://purl.obolibrary.org/obo/ms.obo"},
        {"_id": "UO", "_fullName": "Unit Ontology", "_URI": "https://purl.obolibrary.org/obo/uo.obo"},
    ]},
    "fileDescription": {"fileContent": [{}]},
}


def _cv(p: dict) -> dict:
    return {"_value": ""} | {"_" + b: p.get(a) for a, b in _ATTRIBUTES if p.get(a) is not None}


def _arrays(own: list[dict], arrays: list[dict], default: int, compress: bool) -> list[dict]:
    """binaryDataArray values: of the element's own ones all but type and compression, which are those of this text."""
    out, free = [], list(own)
    for i, a in enumerate(arrays):
        # The element's own array at this place, or else the first of its kind that is left, or none.
        kinds = lambda x: {E.accession_of(p.get("_accession"))[1] for p in x.get("cvParam", ())}
        mine = own[i] if len(own) == len(arrays) else next((x for x in free if a["accession"] in kinds(x)), None)
        if mine is not None and len(own) != len(arrays):
            free.remove(mine)
        dtype, value = a["dtype"] or 1, dict(mine or {})
        text, n = A.encode(a["values"], dtype, compress), len(a["values"])
        kept = [p for p in value.get("cvParam", ()) if p.get("_accession") not in TYPES and p.get("_accession") not in (ZLIB, PLAIN)]
        # Stored rows hold no names; what names the array needs one.
        own_name = lambda p: E.accession_of(p.get("_accession"))[1] == a["accession"] and not p.get("_name")  # noqa: E731, B023
        kept = [p | {"_name": AXIS_TERMS.get(a["accession"], "non-standard data array")} if own_name(p) else p for p in kept]
        if not kept and a["accession"]:
            kept = [_cv({"cv_ref": a.get("cv") or "MS", "accession": f"{a.get('cv') or 'MS'}:{a['accession']:07d}", "name": AXIS_TERMS.get(a["accession"], "non-standard data array")})]
        accession, name = TYPE_TERMS[dtype]
        packed = (ZLIB, "zlib compression") if compress else (PLAIN, "no compression")
        terms = [_cv({"cv_ref": "MS", "accession": k, "name": v}) for k, v in ((accession, name), packed)]
        value.pop("_arrayLength", None)
        lengths = ({"_arrayLength": n} if n != default else {}) | {"_encodedLength": len(text)}
        out.append(lengths | {k: v for k, v in value.items() if k not in ("cvParam", "_encodedLength")} | {"cvParam": terms + kept, "binary": text})
    return out


def _item(tag: str, item: dict, compress: bool) -> Iterator[str]:
    """Lines of a spectrum or chromatogram: its stored element, or what its columns say, with its arrays."""
    arrays = item.get("arrays") or []
    value = E.loaded(tag, item.get("element")) or (_from_columns(item) if tag == "spectrum" else {"cvParam": list(map(_cv, item.get("params") or ()))})
    own = [a for x in value.pop("binaryDataArrayList", ()) for a in x.get("binaryDataArray", ())]
    n = max([len(a["values"]) for a in arrays], default=0)
    value = {"_index": item[f"{tag}_index"], "_id": item.get("id") or value.get("_id") or f"index={item[f'{tag}_index']}", "_defaultArrayLength": n} | {k: v for k, v in value.items() if k not in ("_index", "_id", "_defaultArrayLength")}
    if arrays:
        value["binaryDataArrayList"] = [{"binaryDataArray": _arrays(own, arrays, n, compress)}]
    return E.xml(tag, value)


def _from_columns(s: dict) -> dict:
    scan, scan_list, ions, refs = (s.get(k) or [] for k in ("scan_params", "scan_list_params", "ion_params", "precursor_refs"))
    value: dict = {"_spotID": s.get("spot_id"), "cvParam": list(map(_cv, s.get("params") or ())), "referenceableParamGroupRef": [{"_ref": r} for r in s.get("param_group_refs") or ()]}
    if scan or scan_list:
        value["scanList"] = [{"cvParam": list(map(_cv, scan_list)), "scan": [{"cvParam": list(map(_cv, scan))}]}]
    if refs or ions:
        precursor = {"_spectrumRef": refs[0] if refs else None, "activation": [{}]} | ({"selectedIonList": [{"selectedIon": [{"cvParam": list(map(_cv, ions))}]}]} if ions else {})
        value["precursorList"] = [{"precursor": [precursor]}]
    return {k: v for k, v in value.items() if v}


def document(run_id: str, spectra: Iterable[dict], chromatograms: Iterable[dict] = (), compress: bool = False, head: dict[str, dict] | None = None, counts: tuple[int, int] | None = None) -> Iterator[bytes]:
    """Pieces of an indexed document, made while reading; spectra and chromatograms in their order.

    head: values of the head's elements, the run and the lists by tag, in the current form. counts: of spectra and
    chromatograms; without them both are held to be counted.
    """
    digest, at, places, head = hashlib.sha1(), 0, {"spectrum": [], "chromatogram": []}, head or {}

    def put(text: str) -> bytes:
        nonlocal at
        raw = text.encode()
        digest.update(raw)
        at += len(raw)
        return raw

    if counts is None:
        spectra, chromatograms = list(spectra), list(chromatograms)
        counts = len(spectra), len(chromatograms)
    yield put('<?xml version="1.0" encoding="utf-8"?>\n<indexedmzML xmlns="http://psi.hupo.org/ms/mzml">\n')
    own = {k[1:]: v for k, v in head.get("mzML", {}).items() if k in ("_id", "_accession")}
    yield put(E.start_tag("mzML", {"xmlns": "http://psi.hupo.org/ms/mzml"} | own | {"version": "1.1.0"}) + "\n")
    for tag in _HEAD:
        value = head.get(tag) or _DEFAULTS.get(tag)
        if value:
            yield put("\n".join(E.xml(tag, value)) + "\n")
    run = {"_id": run_id} | {k: v for k, v in head.get("run", {}).items() if k not in ("spectrumList", "chromatogramList")}
    lines = list(E.xml("run", run | {"userParam": run.get("userParam", [])}))
    lines = [E.start_tag("run", {k[1:]: v for k, v in run.items() if k[0] == "_"})] if len(lines) == 1 else lines[:-1]
    yield put("\n".join(lines) + "\n")
    processing = next((p.get("_id") for p in head.get("dataProcessingList", {}).get("dataProcessing", ())), None)
    for kind, items, n in (("spectrum", spectra, counts[0]), ("chromatogram", chromatograms, counts[1])):
        if not n and kind == "chromatogram":
            continue
        stated = head.get(f"{kind}List", {}).get("_defaultDataProcessingRef") or processing
        yield put(E.start_tag(f"{kind}List", {"count": n, "defaultDataProcessingRef": stated}) + "\n")
        for item in items:
            places[kind].append((item.get("id") or f"index={item[f'{kind}_index']}", at))
            yield put("\n".join(_item(kind, item, compress)) + "\n")
        yield put(f"</{kind}List>\n")
    yield put("</run>\n</mzML>\n")
    listed = [(k, v) for k, v in places.items() if v]
    start = at
    yield put(E.start_tag("indexList", {"count": len(listed)}) + "\n")
    for kind, offsets in listed:
        yield put(E.start_tag("index", {"name": kind}) + "\n" + "".join(f"<offset idRef={quoteattr(i)}>{o}</offset>\n" for i, o in offsets) + "</index>\n")
    yield put(f"</indexList>\n<indexListOffset>{start}</indexListOffset>\n<fileChecksum>")
    yield f"{digest.hexdigest()}</fileChecksum>\n</indexedmzML>\n".encode()


def head_values(tags: Iterable[str], elements: Iterable[str | None]) -> dict[str, dict]:
    """Values of a document's head by their current tag; a later element of a tag is left out."""
    out: dict[str, dict] = {}
    for tag, text in zip(tags, elements):
        now = E.ELEMENTS_NOW.get(tag, tag)
        value = E.loaded(now, text)
        if value:
            out.setdefault(now, value)
    return out


_ARRAYS = "array<struct<accession:bigint,cv:string,dtype:smallint,values:array<double>>>"
_WANTED = {"id": "string", "element": "string", "arrays": _ARRAYS, "spot_id": "string", "params": None, "scan_params": None, "scan_list_params": None, "ion_params": None, "precursor_refs": "array<string>", "param_group_refs": "array<string>"}


def documents(spectra: DataFrame, chromatograms: DataFrame | None = None, by: str = "source_path", compress: bool = False, heads: DataFrame | None = None) -> DataFrame:
    """(run, document): the document of each run, made by one task for each run, as its offsets and checksum need.

    Items come sorted, one after the other, so a task holds one document, not its rows. heads: as `mzml.heads` gives them.
    """
    param = "array<" + S.PARAM.simpleString() + ">"

    def one(df: DataFrame, kind: str, order: int) -> DataFrame:
        cols = []
        for name, type_ in _WANTED.items():
            type_ = type_ or param
            if name not in df.columns:
                cols.append(F.lit(None).cast(type_).alias(name))
            elif name == "arrays" and dict(df.select("arrays.cv").dtypes)["cv"] != "array<string>":
                cols.append(F.transform("arrays", lambda a: F.struct(a["accession"], F.lit(None).cast("string").alias("cv"), a["dtype"], a["values"])).cast(type_).alias(name))
            else:
                cols.append(F.col(name).cast(type_).alias(name))
        return df.select(F.col(by).alias("run"), F.lit(order).alias("kind"), F.col(f"{kind}_index").cast("long").alias("at"), F.lit("").alias("tag"), *cols)

    rows = one(spectra, "spectrum", 1)
    if chromatograms is not None:
        rows = rows.unionByName(one(chromatograms, "chromatogram", 2))
    counts = rows.groupBy("run").agg(F.count_if(F.col("kind") == 1).alias("n"), F.count_if(F.col("kind") == 2).alias("m"))
    rows = rows.join(F.broadcast(counts), "run")  # a row for each document
    if heads is not None:
        own = heads.select(F.col(by).alias("run"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), "tag", "element").join(counts, "run", "left")
        rows = rows.unionByName(own, allowMissingColumns=True)
    rows = rows.repartition("run").sortWithinPartitions("run", "kind", "at", "tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for batch in batches:
                for r in range(0, batch.num_rows, 64):
                    yield from batch.slice(r, 64).to_pylist()

        stream = each()
        row = next(stream, None)
        while row is not None:
            name, held = row["run"], []

            def of(kind: int, index: str) -> Iterator[dict]:
                nonlocal row
                while row is not None and row["run"] == name and row["kind"] == kind:  # noqa: B023
                    yield row | {index: row["at"]}
                    row = next(stream, None)

            n, m = row["n"] or 0, row["m"] or 0
            held = [(x["tag"], x["element"]) for x in of(0, "index")]
            head = head_values(*zip(*held)) if held else {}
            parts = document(name, of(1, "spectrum_index"), of(2, "chromatogram_index"), compress, head, (n, m))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b"".join(parts).decode()], pa.string())], names=["run", "document"])

    return rows.mapInArrow(run, "run string, document string")
