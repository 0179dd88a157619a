"""mzML as DataFrames, through Spark's XML reader with one explicit schema for all versions of the format.

Files are split at the ends of `spectrum` and `chromatogram` elements, so a large file is read by many tasks. Legacy
names of elements and attributes are columns of the schema and are joined with the current ones; unknown elements are
left out by the reader.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import scalar as fn

# Accessions of element types, compressions and their element codes.
TYPES = {"MS:1000520": 3, "MS:1000521": 2, "MS:1000523": 1, "MS:1000518": 4, "MS:1000519": 5, "MS:1000522": 6}
ZLIB = "MS:1000574"
NUMPY = {1: "<f8", 2: "<f4", 3: "<f2", 4: "<i2", 5: "<i4", 6: "<i8"}


def _struct(attributes: str, **elements) -> T.StructType:
    fields = [T.StructField("_" + a, T.StringType()) for a in attributes.split()]
    return T.StructType(fields + [T.StructField(k, v) for k, v in elements.items()])


def _many(x: T.DataType) -> T.ArrayType:
    return T.ArrayType(x)


_CV = _struct("cvRef cvLabel accession name value unitCvRef unitCvLabel unitName unitAccession")
_USER = _struct("name type value unitCvRef unitName unitAccession")
_REF = _struct("ref idref")
_PARAMS = {"cvParam": _many(_CV), "userParam": _many(_USER), "referenceableParamGroupRef": _many(_REF), "paramGroupRef": _many(_REF)}
_WINDOW = _struct("", **_PARAMS)
_SCAN = _struct(
    "instrumentConfigurationRef instrumentRef externalSpectrumID sourceFileRef spectrumRef number", **_PARAMS,
    scanWindowList=_struct("count", scanWindow=_many(_WINDOW)), selectionWindowList=_struct("count", selectionWindow=_many(_WINDOW)),
)
_SCANS = _struct("count methodOfCombination", **_PARAMS, scan=_many(_SCAN), acquisition=_many(_SCAN))
_ION = _struct("", **_PARAMS)
_PRECURSOR = _struct(
    "spectrumRef sourceFileRef externalSpectrumID", **_PARAMS, isolationWindow=_WINDOW, activation=_WINDOW,
    selectedIonList=_struct("count", selectedIon=_many(_ION)), ionSelection=_many(_ION),
)
_PRODUCT = _struct("spectrumRef sourceFileRef externalSpectrumID", **_PARAMS, isolationWindow=_WINDOW)
_PRECURSORS, _PRODUCTS = _struct("count", precursor=_many(_PRECURSOR)), _struct("count", product=_many(_PRODUCT))
_ARRAY = _many(_struct("arrayLength encodedLength dataProcessingRef", **_PARAMS, binary=T.StringType()))
_ARRAYS = _struct("count", binaryDataArray=_ARRAY)
_LISTS = {"scanList": _SCANS, "acquisitionList": _SCANS, "scan": _SCAN, "precursorList": _PRECURSORS, "precursor": _many(_PRECURSOR), "productList": _PRODUCTS}
SPECTRUM = _struct(
    "id index nativeID scanNumber defaultArrayLength dataProcessingRef sourceFileRef spotID msLevel", **_PARAMS, **_LISTS,
    spectrumDescription=_struct("", **_PARAMS, **_LISTS), binaryDataArrayList=_ARRAYS, binaryDataArray=_ARRAY,
)
CHROMATOGRAM = _struct("id index nativeID defaultArrayLength dataProcessingRef", **_PARAMS, precursor=_many(_PRECURSOR), product=_many(_PRODUCT), binaryDataArrayList=_ARRAYS, binaryDataArray=_ARRAY)

_COMPONENT = _many(_struct("order", **_PARAMS))
_COMPONENTS = _struct("count", source=_COMPONENT, analyzer=_COMPONENT, detector=_COMPONENT)
_SOFTWARE_REF = _struct("ref")
_INSTRUMENT = _many(
    _struct("id scanSettingsRef", **_PARAMS, componentList=_COMPONENTS, softwareRef=_SOFTWARE_REF, instrumentSoftwareRef=_SOFTWARE_REF, scanSettingsRef=_SOFTWARE_REF)
)
_TERM = _many(_struct("cvRef cvLabel accession name version value"))
_FILE = _many(_struct("id name location sourceFileName sourceFileLocation", **_PARAMS))
_SETTINGS = _many(
    _struct("id instrumentConfigurationRef", **_PARAMS, sourceFileRefList=_struct("count", sourceFileRef=_many(_REF)), targetList=_struct("count", target=_many(_WINDOW)))
)
#: Elements of a document's head: row tag and schema.
HEAD = {
    "cvList": _struct("count", cv=_many(_struct("id cvLabel fullName version URI"))),
    "fileDescription": _struct("", fileContent=_WINDOW, sourceFileList=_struct("count", sourceFile=_FILE), contact=_many(_WINDOW)),
    "referenceableParamGroupList": _struct("count", referenceableParamGroup=_many(_struct("id", **_PARAMS))),
    "sampleList": _struct("count", **_PARAMS, sample=_many(_struct("id name", **_PARAMS))),
    "softwareList": _struct("count", software=_many(_struct("id version", **_PARAMS, softwareParam=_TERM))),
    "scanSettingsList": _struct("count", scanSettings=_SETTINGS),
    "acquisitionSettingsList": _struct("count", acquisitionSettings=_SETTINGS),
    "instrumentConfigurationList": _struct("count", instrumentConfiguration=_INSTRUMENT),
    "instrumentList": _struct("count", instrument=_INSTRUMENT),
    "dataProcessingList": _struct("count", dataProcessing=_many(_struct("id softwareRef", softwareRef=_SOFTWARE_REF, processingMethod=_many(_struct("order softwareRef", **_PARAMS))))),
}


def first_bytes(spark: SparkSession, path: str, n: int = 120) -> bytes:
    """The first bytes of a file, or of the first file of a folder or pattern, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    hadoop = place(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(str(x.getPath()) for x in (fs.globStatus(hadoop) or ()))
    while found and fs.getFileStatus(place(found[0])).isDirectory():
        inside = [x.getPath() for x in fs.listStatus(place(found[0]))]
        found = sorted(str(x) for x in inside if not x.getName().startswith((".", "_")))
    if not found:
        return b""
    stream = fs.open(place(found[0]))
    try:
        return bytes(b & 0xFF for b in (stream.read() for _ in range(n)) if b >= 0)
    finally:
        stream.close()


def declared_charset(spark: SparkSession, path: str) -> str:
    """The encoding that the first document of a path declares; UTF-8 if it says nothing."""
    said = re.search(rb"""encoding\s*=\s*["']([\w.-]+)""", first_bytes(spark, path))
    return said[1].decode() if said else "UTF-8"


def _charset(spark: SparkSession, path: str, charset: str | None) -> str:
    return charset or declared_charset(spark, path)


def rows(spark: SparkSession, path: str, tag: str, schema: T.StructType, charset: str | None = None) -> DataFrame:
    """Elements of a tag, with the file they come from. charset: as declared by the path's first document, unless given.

    The elements that a file has many of are cut out of its text, which Spark splits, and parsed one by one; an element
    that is not well-formed, as where a file breaks off, raises. Others go through Spark's reader, which takes a file
    to a task and parses what is within the tag only.
    """
    charset = _charset(spark, path, charset)
    if tag not in ("spectrum", "chromatogram"):
        reader = spark.read.format("xml").option("rowTag", tag).option("charset", charset).option("mode", "PERMISSIVE").schema(schema)
        return reader.load(path).withColumn("source_path", F.input_file_name())
    text = spark.read.option("lineSep", f"</{tag}>").option("encoding", charset).text(path)
    # An element may be closed in its own start tag, so several can stand before one end tag.
    text = text.select(F.input_file_name().alias("source_path"), F.explode(F.split("value", rf"(?=<{tag}[\s>/])")).alias("text")).where(F.col("text").rlike(rf"^<{tag}[\s>/]"))
    alone = F.regexp_extract("text", rf"^<{tag}\b[^>]*/>", 0)
    whole = F.when(alone != "", alone).otherwise(F.concat("text", F.lit(f"</{tag}>")))
    parsed = F.from_xml(whole, schema, {"mode": "FAILFAST"})
    return text.select(parsed.alias("x"), "source_path").select("x.*", "source_path")


def truncated(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """(source_path) of documents without their end tag."""
    cut = pieces(spark, path, charset)
    return cut.groupBy("source_path").agg(F.bool_or(F.col("text").endswith("</mzML")).alias("whole")).where("not whole").select("source_path")


def head(spark: SparkSession, path: str, element: str, charset: str | None = None) -> DataFrame:
    """An element of the documents' heads (a key of HEAD), as nested rows."""
    return rows(spark, path, element, HEAD[element], charset)


def pieces(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """(source_path, at, text): the documents cut behind each `>`, in order. Files are split, whatever their lines."""
    reader = spark.read.option("lineSep", ">").option("encoding", _charset(spark, path, charset))
    return reader.text(path).select(F.input_file_name().alias("source_path"), F.monotonically_increasing_id().alias("at"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text"))


def run_heads(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """(source_path, tag, element): the documents' `run` without its lists, and attributes of `mzML` and of the lists, as JSON."""
    cut = pieces(spark, path, charset)
    opens = cut.where(F.col("text").rlike(r"<(run|mzML|spectrumList|chromatogramList)( |$|/)")).withColumn("tag", F.regexp_extract("text", r"<(run|mzML|spectrumList|chromatogramList)", 1))
    # From the run's own tag to the first of its lists, or its end: a few pieces of each document.
    first = F.min(F.when(F.col("tag") == "run", F.col("at")))
    last = F.coalesce(F.min(F.when(F.col("tag").isin("spectrumList", "chromatogramList"), F.col("at"))), F.lit(1 << 62))
    bounds = opens.groupBy("source_path").agg(first.alias("lo"), last.alias("hi")).where("lo is not null")
    stops = cut.where(F.col("text") == "</run").groupBy("source_path").agg(F.min("at").alias("stop"))
    bounds = bounds.join(stops, "source_path", "left").select("source_path", "lo", F.least("hi", F.coalesce("stop", "hi")).alias("hi"))
    inside = cut.join(bounds, "source_path").where("at >= lo and at < hi").select("source_path", F.lit("run").alias("tag"), "at", "text")
    alone = opens.where("tag <> 'run'").select("source_path", "tag", "at", "text")
    told = inside.unionByName(alone).groupBy("source_path", "tag").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xml.etree import ElementTree

        def value(x) -> dict:
            out: dict = {"_" + k: v for k, v in x.attrib.items() if "}" not in k}
            for child in x:
                out.setdefault(child.tag, []).append(value(child))
            return out

        for batch in batches:
            out = []
            for tag, parts in zip(batch.column("tag").to_pylist(), batch.column("p").to_pylist()):
                text = ">".join(p["text"] for p in (parts if tag == "run" else parts[:1])) + ">"
                text = re.sub(r"\sxmlns(:\w+)?=\"[^\"]*\"|\s\w+:\w+=\"[^\"]*\"", "", text[text.index("<" + tag) :])
                closed = text.endswith("/>") and text.count("<") == 1
                out.append(json.dumps(value(ElementTree.fromstring(text if closed else f"{text}</{tag}>"))))
            yield pa.RecordBatch.from_arrays([batch.column("source_path"), batch.column("tag"), pa.array(out, pa.string())], names=["source_path", "tag", "element"])

    return told.mapInArrow(parse, "source_path string, tag string, element string")


def heads(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """(source_path, tag, element): all that documents hold beside spectra and chromatograms, as JSON of nested values."""
    charset = _charset(spark, path, charset)
    out = run_heads(spark, path, charset)
    for tag in HEAD:
        one = head(spark, path, tag, charset)
        names = [c for c in one.columns if c != "source_path"]
        out = out.unionByName(one.select("source_path", F.lit(tag).alias("tag"), F.to_json(F.struct(*names)).alias("element")))
    return out


def targets(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """(source_path, settings, target_no, name, mz, lo, hi) of the scan settings' targets.

    lo and hi are the stated bounds, or the m/z with the offsets that are stated. Settings without target elements may
    list targets among their own parameters.
    """
    from ..operators import metadata

    cells, own = None, None
    for tag, one in (("scanSettingsList", "scanSettings"), ("acquisitionSettingsList", "acquisitionSettings")):
        x = head(spark, path, tag, charset).select("source_path", F.posexplode(one).alias("settings_no", "s"))
        x = x.select("source_path", F.struct("source_path", F.lit(tag).alias("tag"), "settings_no").alias("item"), F.col("s._id").alias("settings"), F.coalesce("s.targetList.target", F.array()).alias("t"), _params("s.cvParam").alias("p"))
        listed = x.where(F.size("t") > 0).select("item", "settings", F.posexplode("t").alias("target_no", "t")).select("item", "settings", "target_no", F.explode(_params("t.cvParam")).alias("p"))
        loose = x.where(F.size("t") == 0).select("item", "settings", F.posexplode("p").alias("row_no", "p"))
        cells, own = (listed, loose) if cells is None else (cells.unionByName(listed), own.unionByName(loose))
    found = metadata.targets_of_params(own.select("item", "row_no", F.col("p.accession").alias("accession"), F.col("p.value").alias("value")))
    names = own.select("item", "settings").distinct()
    cells = cells.select("item", "settings", "target_no", F.col("p.accession").alias("accession"), F.col("p.value").alias("value"))
    cells = cells.unionByName(found.join(names, "item").select("item", "settings", "target_no", "accession", "value"))
    said = lambda *a: F.max(F.when(F.col("accession").isin(*a), F.col("value")))
    number = lambda *a: said(*a).try_cast("double")
    mz, zero = number(metadata.TARGET_MZ, "MS:1000744", "MS:1000040"), F.lit(0.0)
    lo = F.coalesce(number(metadata.TARGET_START), mz - F.coalesce(number("MS:1000828"), zero))
    hi = F.coalesce(number(metadata.TARGET_END), mz + F.coalesce(number("MS:1000829"), zero))
    out = cells.groupBy("item", "settings", "target_no").agg(said(metadata.TARGET_NAME).alias("name"), mz.alias("mz"), lo.alias("lo"), hi.alias("hi"))
    return out.select(F.col("item.source_path").alias("source_path"), "settings", "target_no", "name", "mz", "lo", "hi")


def index(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """(source_path, index_name, id_ref, offset) of the files' index lists; offsets that are no numbers are 0; none without a list."""
    schema = _struct("name", offset=_many(T.StructType([T.StructField(n, T.StringType()) for n in ("_VALUE", "_idRef", "_nativeID", "_spotID")])))
    out = rows(spark, path, "index", schema, charset).select("source_path", F.col("_name").alias("index_name"), F.explode("offset").alias("o"))
    return out.select("source_path", "index_name", F.col("o._idRef").alias("id_ref"), F.coalesce(F.trim("o._VALUE").try_cast("long"), F.lit(0)).alias("offset"))


def index_tail(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """(source_path, index_list_offset, file_checksum) of the documents that state them; null where one is missing."""
    cut = pieces(spark, path, charset)
    said = lambda tag: F.max(F.when(F.col("text").endswith(f"</{tag}"), F.trim(F.regexp_replace("text", f"</{tag}$", ""))))
    ends = cut.where(F.col("text").endswith("</indexListOffset") | F.col("text").endswith("</fileChecksum"))
    return ends.groupBy("source_path").agg(said("indexListOffset").try_cast("long").alias("index_list_offset"), said("fileChecksum").alias("file_checksum"))


def _params(x: str) -> Column:
    """Parameters of an element as array<struct> with the current names; null vocabulary attributes take the legacy ones."""

    def one(p: Column) -> Column:
        cv = F.coalesce(p["_cvRef"], p["_cvLabel"])
        unit = F.coalesce(p["_unitCvRef"], p["_unitCvLabel"])
        return F.struct(cv.alias("cv_ref"), p["_accession"].alias("accession"), p["_name"].alias("name"), p["_value"].alias("value"), unit.alias("unit_cv_ref"), p["_unitName"].alias("unit_name"), p["_unitAccession"].alias("unit_accession"))

    return F.transform(F.coalesce(F.col(x), F.array()), one) if isinstance(x, str) else F.transform(F.coalesce(x, F.array()), one)


def element_type(accessions: list[str]) -> int:
    """Element type of an array by its parameters; the lone narrow ones first, double precision without any."""
    codes = {TYPES[a] for a in accessions if a in TYPES}
    # A type counts if none of these others is stated as well; the rest goes by the order of the list.
    for code, unless in ((3, {1, 2}), (4, {5, 6}), (5, {6}), (6, {1, 2}), (1, set()), (2, set()), (6, set())):
        if code in codes and not codes & unless:
            return code
    return 1


def decode(text: str | None, accessions: list[str], length: int | None = None) -> np.ndarray:
    """Values of an encoded array; a partial last element is dropped, and what is beyond the stated length."""
    raw = base64.b64decode("".join((text or "").split()) or "")
    code = element_type(accessions)
    if ZLIB in accessions and raw:
        box = zlib.decompressobj()
        raw = box.decompress(raw, length * 8 + 1024 if length else 2 << 30)
    kind = np.dtype(NUMPY[code])
    out = np.frombuffer(raw[: len(raw) // kind.itemsize * kind.itemsize], kind)
    return out[:length] if length is not None and length < len(out) else out


_DECODED = "array<struct<accession:bigint,cv:string,dtype:smallint,values:array<double>>>"


def _decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("accession", pa.int64()), ("cv", pa.string()), ("dtype", pa.int16()), ("values", pa.list_(pa.float64()))]))
    for batch in batches:
        out = []
        for arrays in batch.column("raw").to_pylist():
            row = []
            for a in arrays or ():
                accessions = [x["accession"] or "" for x in a["params"]]
                # The first of the known axes, else the first parameter that names an array.
                known = next((x for x in accessions if x in ("MS:1000514", "MS:1000515", "MS:1000595")), None)
                named = known or next((x["accession"] for x in a["params"] if " array" in (x["name"] or "").lower() and any(c.isdigit() for c in x["accession"] or "")), "")
                digits = "".join(c for c in named.rpartition(":")[2] if c.isdigit())
                length = int(a["length"]) if (a["length"] or "").isdigit() else None
                stated = length if length is not None else int(a["default"]) if (a["default"] or "").isdigit() else None
                values = decode(a["binary"], accessions, stated)
                row.append({"accession": int(digits or 0), "cv": named.partition(":")[0] or None, "dtype": element_type(accessions), "values": values.astype(np.float64)})
            out.append(row)
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names) if n != "raw"), pa.array(out, kind)], names=[*(n for n in batch.schema.names if n != "raw"), "arrays"])


def _with_arrays(df: DataFrame) -> DataFrame:
    """Replaces the encoded arrays by typed ones."""
    one = lambda a: F.struct(a["_arrayLength"].alias("length"), F.col("_defaultArrayLength").alias("default"), _params(a["cvParam"]).alias("params"), a["binary"].alias("binary"))
    raw = df.withColumn("raw", F.transform(F.coalesce("binaryDataArrayList.binaryDataArray", "binaryDataArray", F.array()), one)).drop("binaryDataArrayList", "binaryDataArray")
    kept = raw.drop("raw").schema
    schema = T.StructType([*kept.fields, T.StructField("arrays", T._parse_datatype_string(_DECODED))])
    return raw.select(*kept.names, "raw").mapInArrow(_decoder, schema)


def _located(p: Column, level: str) -> Column:
    return F.transform(p, lambda x: x.withField("level", F.lit(level)))


def _numbered(x: DataFrame, out: str) -> DataFrame:
    """x with the elements' own index, or else their place in their file, from 0.

    Only a slim copy is counted: a row for each partition and file holds the first number, so no arrays are moved.
    """
    x = x.withColumns({"seq": F.monotonically_increasing_id(), "own_index": F.col("_index").try_cast("long")})
    slim = x.select("source_path", F.shiftright("seq", 33).alias("part"), "seq")
    stats = slim.groupBy("source_path", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("source_path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stats.select("source_path", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "first")
    x = x.withColumn("part", F.shiftright("seq", 33)).join(F.broadcast(base), ["source_path", "part"])  # a row for each split of a file
    return x.withColumn(out, F.coalesce("own_index", F.col("base") + F.col("seq") - F.col("first"))).drop("seq", "own_index", "part", "base", "first")


def _element(x: DataFrame, schema: T.StructType) -> Column:
    """The element itself as JSON, without its binary data."""
    light = lambda a: F.transform(a, lambda y: y.dropFields("binary"))
    whole = F.when(F.col("binaryDataArrayList").isNotNull(), F.col("binaryDataArrayList").withField("binaryDataArray", light(F.col("binaryDataArrayList.binaryDataArray"))))
    special = {"binaryDataArrayList": whole, "binaryDataArray": light(F.col("binaryDataArray"))}
    return F.to_json(F.struct(*(special.get(n, F.col(n)).alias(n) for n in schema.names)))


def spectra(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """One row for each spectrum, in the files' order: identity, summary, parameters, lists, typed arrays, and the
    element itself as JSON (`element`: all that it holds but binary data).

    spectrum_index is the element's own index, else its place in its file.
    """
    return typed_spectra(_numbered(rows(spark, path, "spectrum", SPECTRUM, charset), "spectrum_index"))


def typed_spectra(x: DataFrame) -> DataFrame:
    """What `spectra` gives, of raw elements with a source_path and a spectrum_index; of streams as well."""
    d = lambda name: F.coalesce(F.col(name), F.col(f"spectrumDescription.{name}"))
    own = _params("cvParam")
    described = F.filter(_params("spectrumDescription.cvParam"), lambda p: ~F.exists(own, lambda q: q["accession"] == p["accession"]))
    level = F.struct(F.lit("MS").alias("cv_ref"), F.lit("MS:1000511").alias("accession"), F.lit("ms level").alias("name"), F.col("_msLevel").alias("value"), *(F.lit(None).cast("string").alias(n) for n in ("unit_cv_ref", "unit_name", "unit_accession")))
    has_level = F.exists(own, lambda q: q["accession"] == "MS:1000511")
    params = F.when(F.col("_msLevel").isNotNull() & ~has_level, F.concat(own, F.array(level))).otherwise(own)
    scan_list = F.coalesce(d("scanList"), d("acquisitionList"))
    lone = d("scan")
    scans_ = F.coalesce(scan_list["scan"], scan_list["acquisition"], F.when(lone.isNotNull(), F.array(lone)), F.array())
    precursors = F.coalesce(d("precursorList")["precursor"], d("precursor"), F.array())
    ions = F.flatten(F.transform(precursors, lambda p: F.coalesce(p["selectedIonList"]["selectedIon"], p["ionSelection"], F.array())))
    out = x.select(
        "source_path", "spectrum_index", F.coalesce("_id", F.lit("")).alias("id"), F.col("_nativeID").alias("native_id"),
        F.col("_scanNumber").try_cast("int").alias("scan_number"), F.col("_spotID").alias("spot_id"), "_defaultArrayLength", F.col("_dataProcessingRef").alias("data_processing_ref"),
        params.alias("params"), described.alias("described_params"), F.coalesce("userParam", F.array()).alias("user_params"),
        F.transform(F.coalesce("referenceableParamGroupRef", "paramGroupRef", F.array()), lambda r: F.coalesce(r["_ref"], r["_idref"])).alias("param_group_refs"),
        F.flatten(F.transform(scans_, lambda s: _params(s["cvParam"]))).alias("scan_params"),
        _params(scan_list["cvParam"]).alias("scan_list_params"), F.flatten(F.transform(ions, lambda i: _params(i["cvParam"]))).alias("ion_params"),
        F.transform(precursors, lambda p: p["_spectrumRef"]).alias("precursor_refs"), _element(x, SPECTRUM).alias("element"), "binaryDataArrayList", "binaryDataArray",
    )
    return _summarised(_with_arrays(out)).withColumnRenamed("_defaultArrayLength", "default_array_length")


def _summarised(x: DataFrame) -> DataFrame:
    """Summary columns from the parameters of a row: the last that a spectrum states, the first finite start time."""
    nan = F.lit(float("nan"))

    def last(accession: str) -> Column:
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("params", lambda p: p["accession"] == accession), lambda p: p["value"])), -1)

    number = lambda a: F.coalesce(last(a).try_cast("double"), nan)
    signs = F.transform(F.filter("params", lambda p: p["accession"].isin("MS:1000130", "MS:1000129")), lambda p: F.when(p["accession"] == "MS:1000130", 1).otherwise(2))
    timed = F.filter(F.concat("scan_params", "scan_list_params"), lambda p: (p["accession"] == "MS:1000016") & fn.is_finite(p["value"].try_cast("double")))
    first = F.get(timed, F.lit(0))
    selected = F.get(F.filter("ion_params", lambda p: p["accession"].isin("MS:1000744", "MS:1000040")), F.lit(0))["value"].try_cast("double")
    spot = lambda a: F.coalesce(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("scan_params", lambda p: p["accession"] == a), lambda p: p["value"])), -1).try_cast("int"), F.lit(0))
    return x.withColumns(
        {
            "ms_level": F.coalesce(last("MS:1000511").try_cast("short"), F.lit(0).cast("short")),
            "polarity": F.coalesce(F.element_at(F.concat(F.array(F.lit(None).cast("int")), signs), -1), F.lit(0)).cast("short"),
            "rt": F.coalesce(first["value"].try_cast("double"), nan), "rt_unit": fn.time_unit(first["unit_accession"], first["unit_name"]),
            "base_peak_mz": number("MS:1000504"), "base_peak_int": number("MS:1000505"), "total_ion_current": number("MS:1000285"), "selected_ion_mz": F.coalesce(selected, nan),
            "position_x": spot("IMS:1000050"), "position_y": spot("IMS:1000051"), "position_z": spot("IMS:1000052"),
        }
    )


def chromatograms(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """One row for each chromatogram: identity, parameters, at most one precursor and product, and typed arrays."""
    x = _numbered(rows(spark, path, "chromatogram", CHROMATOGRAM, charset), "chromatogram_index")
    isolation = lambda c: _params(F.get(F.col(c), F.lit(0))["isolationWindow"]["cvParam"])
    out = x.select(
        "source_path", "chromatogram_index", F.coalesce("_id", F.lit("")).alias("id"), F.col("_nativeID").alias("native_id"), "_defaultArrayLength",
        _params("cvParam").alias("params"), F.coalesce("userParam", F.array()).alias("user_params"), isolation("precursor").alias("precursor_window"), isolation("product").alias("product_window"),
        _element(x, CHROMATOGRAM).alias("element"), "binaryDataArrayList", "binaryDataArray",
    )
    return _with_arrays(out).withColumnRenamed("_defaultArrayLength", "default_array_length")


def peaks(spectra_: DataFrame, width: float = S.MZ_WIDTH) -> DataFrame:
    """Peaks in long form: m/z and intensity by position, as many as the shorter array has."""
    x, y = fn.first_array(F.col("arrays"), S.MZ), fn.first_array(F.col("arrays"), S.INTENSITY)
    n = F.least(F.size(x), F.size(y))
    zipped = F.arrays_zip(F.slice(x, F.lit(1), n).alias("mz"), F.slice(y, F.lit(1), n).alias("intensity"))
    out = spectra_.where(n > 0).select(F.col("source_path").alias("run_id"), "spectrum_index", F.posexplode(zipped).alias("pos", "p"))
    return out.select("run_id", "spectrum_index", "pos", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"), fn.window_index(F.col("p.mz"), width).alias("mz_bin"))


def dangling_references(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """(source_path, kind, ref) of spectra's references that name nothing in their document: parameter groups, data
    processing and precursor spectra."""
    s = spectra(spark, path, charset)
    one = lambda kind, x: s.select("source_path", F.lit(kind).alias("kind"), x.alias("ref")).where("ref IS NOT NULL")
    refs = one("param_group", F.explode("param_group_refs")).union(one("data_processing", F.col("data_processing_ref"))).union(one("spectrum", F.explode("precursor_refs")))
    groups = head(spark, path, "referenceableParamGroupList", charset).select("source_path", F.explode("referenceableParamGroup").alias("g"))
    processing = head(spark, path, "dataProcessingList", charset).select("source_path", F.explode("dataProcessing").alias("g"))
    ids = [x.select("source_path", F.lit(k).alias("kind"), F.col("g._id").alias("ref")) for k, x in (("param_group", groups), ("data_processing", processing))]
    known = ids[0].union(ids[1]).union(s.select("source_path", F.lit("spectrum").alias("kind"), F.col("id").alias("ref")))
    return refs.distinct().join(known.distinct(), ["source_path", "kind", "ref"], "left_anti")


def parameters(spectra_: DataFrame) -> DataFrame:
    """A row for each parameter of each spectrum: where it stands (level), its place, and its fields.

    Levels are spectrum, scan, scan_list and selected_ion; `summaries.spectrum_summaries` reads this form.
    """
    parts = F.concat(*(_located(F.col(c), level) for c, level in (("params", "spectrum"), ("scan_params", "scan"), ("scan_list_params", "scan_list"), ("ion_params", "selected_ion"))))
    return spectra_.select("source_path", "spectrum_index", F.posexplode(parts).alias("row_no", "p")).select("source_path", "spectrum_index", "row_no", "p.*")


def stream(spark: SparkSession, path: str, charset: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """Spectra of the files of a folder as they come, as `spectra` gives them; those without an index have none."""
    reader = spark.readStream.format("xml").option("rowTag", "spectrum").option("charset", _charset(spark, path, charset)).option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.schema(SPECTRUM).load(path).withColumn("source_path", F.input_file_name())
    return typed_spectra(raw.withColumn("spectrum_index", F.col("_index").try_cast("long")))
