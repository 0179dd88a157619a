"""Elements of documents as nested values: names of the current version, rows of stored metadata, and XML.

A value is a dict as Spark's XML reader gives it in JSON: attributes by "_name", child elements by name. In the
current form (`current`) all children are lists, legacy names are replaced, and lists are wrapped as version 1.1 has it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from .. import schema as S

# Numbers of attributes in stored metadata.
ATTRIBUTES = {
    "fullName": 9_900_002, "cvVersion": 9_900_003, "URI": 9_900_004,
    "id": 9_910_001, "ref": 9_910_002, "name": 9_910_003, "location": 9_910_004, "startTimeStamp": 9_910_005, "defaultInstrumentConfigurationRef": 9_910_006,
    "defaultSourceFileRef": 9_910_007, "sampleRef": 9_910_008, "defaultDataProcessingRef": 9_910_009, "dataProcessingRef": 9_910_010, "sourceFileRef": 9_910_011,
    "nativeID": 9_910_012, "spotID": 9_910_013, "externalSpectrumID": 9_910_014, "spectrumRef": 9_910_015, "scanSettingsRef": 9_910_016,
    "instrumentConfigurationRef": 9_910_017, "softwareRef": 9_910_018, "version": 9_910_019, "label": 9_910_020,
    "count": 9_910_100, "order": 9_910_101, "index": 9_910_102, "scanNumber": 9_910_103, "defaultArrayLength": 9_910_104, "arrayLength": 9_910_105,
    "encodedLength": 9_910_106, "msLevel": 9_910_107,
}
_NAMES = {v: k for k, v in ATTRIBUTES.items()}
_TAG = {name: code for code, name in enumerate(S.TAGS)}

# Legacy names of elements and attributes.
ELEMENTS_NOW = {
    "paramGroupRef": "referenceableParamGroupRef", "acquisitionList": "scanList", "acquisition": "scan", "selectionWindowList": "scanWindowList", "selectionWindow": "scanWindow",
    "instrumentList": "instrumentConfigurationList", "instrument": "instrumentConfiguration", "acquisitionSettingsList": "scanSettingsList", "acquisitionSettings": "scanSettings",
    "instrumentSoftwareRef": "softwareRef",
}
ATTRIBUTES_NOW = {
    "cvLabel": "cvRef", "unitCvLabel": "unitCvRef", "idref": "ref", "instrumentRef": "instrumentConfigurationRef", "sourceFileName": "name", "sourceFileLocation": "location",
}
_FIRST = {"referenceableParamGroupRef": 0, "cvParam": 1, "userParam": 2}
#: Children that stand before the parameters, and the order of some others.
_BEFORE = {"scanSettings": ("sourceFileRefList",), "run": ("sourceFileRefList",)}
_ORDER = ("isolationWindow", "selectedIonList", "activation", "componentList", "softwareRef")
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
#: Row of stored metadata: own node, parent, tag, vocabulary, accession, unit's vocabulary, unit's accession, text.
Row = tuple[int, int, int, int, int, int, int, str | None]


def current(tag: str, value: dict) -> dict:
    """A value in the current form."""
    out: dict = {}
    for k, v in value.items():
        if v is None or v == []:
            continue
        if k.startswith("_"):
            name = "id" if (tag, k) == ("cv", "_cvLabel") else ATTRIBUTES_NOW.get(k[1:], k[1:])
            out.setdefault("_" + name, v)
        else:
            name = ELEMENTS_NOW.get(k, k)
            out.setdefault(name, []).extend(current(name, x) for x in (v if isinstance(v, list) else [v]))
    if tag in ("spectrum", "spectrumDescription"):
        _spectrum(out)
    elif tag == "precursor" and "ionSelection" in out:
        out.setdefault("selectedIonList", [{"selectedIon": out.pop("ionSelection")}])
    elif tag in ("chromatogram",) and "binaryDataArray" in out:
        out.setdefault("binaryDataArrayList", [{"binaryDataArray": out.pop("binaryDataArray")}])
    elif tag == "software":
        for p in out.pop("softwareParam", ()):
            if p.get("_version"):
                out.setdefault("_version", p["_version"])
            out.setdefault("cvParam", []).append({"_value": ""} | {k: v for k, v in p.items() if k != "_version"})
    elif tag == "dataProcessing":
        ref = out.pop("_softwareRef", None) or next((r.get("_ref") for r in out.pop("softwareRef", ())), None)
        for method in out.get("processingMethod", ()):
            if ref and "_softwareRef" not in method:
                method["_softwareRef"] = ref
    elif tag == "instrumentConfiguration" and "scanSettingsRef" in out:
        out.setdefault("_scanSettingsRef", out.pop("scanSettingsRef")[0].get("_ref"))
    return out


def _spectrum(out: dict) -> None:
    for described in out.pop("spectrumDescription", ()):
        own = {p.get("_accession") for p in out.get("cvParam", ())}
        for k, v in described.items():
            if k == "cvParam":
                v = [p for p in v if p.get("_accession") not in own]
                out.setdefault(k, []).extend(v)
            elif k in ("userParam", "referenceableParamGroupRef"):
                out.setdefault(k, []).extend(v)
            else:
                out.setdefault(k, v)
    for child, holder in (("scan", "scanList"), ("precursor", "precursorList"), ("binaryDataArray", "binaryDataArrayList")):
        if child in out:
            out.setdefault(holder, [{child: out.pop(child)}])
    level = out.pop("_msLevel", None)
    if level is not None and not any(p.get("_accession") == "MS:1000511" for p in out.get("cvParam", ())):
        out.setdefault("cvParam", []).append({"_cvRef": "MS", "_accession": "MS:1000511", "_name": "ms level", "_value": level})


def loaded(tag: str, text: str | None) -> dict:
    """The current form of an element that is stored as JSON."""
    return current(tag, json.loads(text)) if text else {}


# --- rows of stored metadata ---------------------------------------------------------------------------


def accession_of(text: str | None) -> tuple[int, int]:
    """The vocabulary's code and the number of an accession."""
    prefix, _, tail = (text or "").rpartition(":")
    digits = "".join(c for c in tail if c.isdigit())
    return S.CV_CODES.get(prefix, S.CV_UNKNOWN), int(digits or 0)


def _text_of(cv: int, accession: int) -> str | None:
    """The accession that a stored pair stands for; None if it has none."""
    prefix = next((k for k, v in S.CV_CODES.items() if v == cv), None)
    if prefix is None:
        return None
    return f"{prefix}:C{accession}" if prefix == "NCIT" else f"{prefix}:{accession:07d}"


def rows(tag: str, value: dict, parent: int = 1, first: int = 2) -> list[Row]:
    """Rows of a value in the current form; node numbers count up from `first`. Binary data is left out."""
    out: list[Row] = []
    number = first - 1

    def walk(tag: str, value: dict, parent: int) -> None:
        nonlocal number
        number += 1
        node, code = number, _TAG.get(tag, 255)
        named = [(ATTRIBUTES["cvVersion"] if (tag, k) == ("cv", "_version") else ATTRIBUTES[k[1:]], str(v)) for k, v in value.items() if k[0] == "_" and k[1:] in ATTRIBUTES and k != "_encodedLength"]
        for accession, text in named:
            out.append((node, parent, code, S.CV_CODES["ATTR"], accession, S.CV_UNKNOWN, 0, text))
        if not named:
            out.append((node, parent, code, S.CV_UNKNOWN, 0, S.CV_UNKNOWN, 0, None))
        for p in value.get("cvParam", ()):
            number += 1
            out.append((number, node, _TAG["cvParam"], *accession_of(p.get("_accession")), *accession_of(p.get("_unitAccession")), p.get("_value")))
        for p in value.get("userParam", ()):
            number += 1
            said = "\0".join(p.get(k) or "" for k in ("_name", "_value", "_type"))
            out.append((number, node, _TAG["userParam"], S.CV_UNKNOWN, 0, *accession_of(p.get("_unitAccession")), said))
        for k, children in value.items():
            if k[0] != "_" and k not in ("cvParam", "userParam", "binary"):
                for child in children:
                    walk(k, child, node)

    walk(tag, value, parent)
    return out


def assembled(stored: list[Row], names: dict[str, str] | None = None) -> Iterator[tuple[str, dict]]:
    """(tag, value) of the elements at the top of rows, rebuilt; names: of accessions, which rows do not hold."""
    names, values, tags, top = names or {}, {}, {}, []
    for node, parent, tag, cv, accession, unit_cv, unit, text in stored:
        unit_text = _text_of(unit_cv, unit)
        more = {"_unitCvRef": unit_text.partition(":")[0], "_unitAccession": unit_text} | ({"_unitName": names[unit_text]} if unit_text in names else {}) if unit_text else {}
        if tag == _TAG["cvParam"] and cv != S.CV_CODES["ATTR"]:
            full = _text_of(cv, accession)
            known = {"_cvRef": full.partition(":")[0], "_accession": full} if full else {}
            values[parent].setdefault("cvParam", []).append(known | {"_name": names.get(full, "")} | {"_value": text or ""} | more)
        elif tag == _TAG["userParam"]:
            said = dict(zip(("_name", "_value", "_type"), ((text or "").split("\0", 2) + ["", ""])[:3]))
            values[parent].setdefault("userParam", []).append({k: v for k, v in said.items() if v or k == "_name"} | more)
        else:
            if node not in values:
                values[node], tags[node] = {}, S.TAGS[tag] if tag < len(S.TAGS) else "unknown"
                if parent in values:
                    values[parent].setdefault(tags[node], []).append(values[node])
                else:
                    top.append(node)
            if cv == S.CV_CODES["ATTR"] and accession in _NAMES:
                name = "version" if _NAMES[accession] == "cvVersion" else _NAMES[accession]
                values[node].setdefault("_" + name, text or "")
    for node in top:
        yield tags[node], values[node]


# --- XML -----------------------------------------------------------------------------------------------


def start_tag(tag: str, attributes: dict, close: bool = False) -> str:
    parts = [tag]
    for k, v in attributes.items():
        if v is not None:
            if _ILLEGAL.search(str(v)):
                raise S.Malformed(f"{tag} {k}: a character that XML does not allow")
            parts.append(f"{k}={quoteattr(str(v))}")
    return "<" + " ".join(parts) + ("/>" if close else ">")


def _place(tag: str, name: str) -> tuple[int, int]:
    if name in _BEFORE.get(tag, ()):
        return -1, 0
    return _FIRST.get(name, 3), _ORDER.index(name) if name in _ORDER else -1


def xml(tag: str, value: dict) -> Iterator[str]:
    """Lines of a value in the current form; counts of lists follow their items."""
    attributes = {k[1:]: v for k, v in value.items() if k[0] == "_"}
    children = sorted(((k, v) for k, v in value.items() if k[0] != "_" and k != "binary"), key=lambda x: _place(tag, x[0]))
    if tag.endswith("List") and tag not in ("spectrumList", "chromatogramList"):
        attributes["count"] = sum(len(v) for k, v in children if k not in _FIRST)
    text = value.get("binary")
    if text is not None:
        yield start_tag(tag, attributes)
        for k, v in children:
            for child in v:
                yield from xml(k, child)
        yield f"<binary>{escape(text)}</binary>"
        yield f"</{tag}>"
    elif not children:
        yield start_tag(tag, attributes, True)
    else:
        yield start_tag(tag, attributes)
        for k, v in children:
            for child in v:
                yield from xml(k, child)
        yield f"</{tag}>"
