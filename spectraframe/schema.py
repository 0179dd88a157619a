"""Schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Accession numbers of axes, as the exchange format defines them.
MZ, INTENSITY, TIME = 1000514, 1000515, 1000595
AXES = {"mz": MZ, "intensity": INTENSITY, "time": TIME}

# Codes of vocabularies, element types, polarities, time units and value kinds in stored tables.
CV_CODES = {"MS": 0, "UO": 1, "NCIT": 2, "PEFF": 3, "ATTR": 4, "IMS": 5}
CV_UNKNOWN = 255
DTYPE_CODES = {"f64": 1, "f32": 2, "f16": 3, "i16": 4, "i32": 5, "i64": 6}
DTYPE_BYTES = {1: 8, 2: 4, 3: 2, 4: 2, 5: 4, 6: 8}
POLARITY_UNKNOWN, POLARITY_POSITIVE, POLARITY_NEGATIVE = 0, 1, 2
UNIT_OTHER, UNIT_SECOND, UNIT_MINUTE, UNIT_MILLISECOND = 0, 1, 2, 3
VALUE_NUMBER, VALUE_TEXT, VALUE_EMPTY = 0, 1, 2

# Elements by their tag code in stored metadata; 255 is unknown.
TAGS = (
    "fileContent", "sourceFile", "contact", "referenceableParamGroup", "sample", "instrumentConfiguration", "source", "analyzer", "detector", "software", "processingMethod", "scanSettings",
    "target", "run", "spectrum", "spectrumDescription", "scan", "scanWindow", "precursor", "isolationWindow", "selectedIon", "activation", "product", "binaryDataArray", "chromatogram",
    "fileDescription", "sourceFileList", "sourceFileRef", "sourceFileRefList", "referenceableParamGroupList", "referenceableParamGroupRef", "sampleList", "instrumentConfigurationList",
    "componentList", "softwareList", "softwareParam", "softwareRef", "dataProcessing", "dataProcessingList", "scanSettingsList", "acquisitionSettings", "acquisitionSettingsList", "targetList",
    "spectrumList", "scanList", "scanWindowList", "precursorList", "selectedIonList", "productList", "binaryDataArrayList", "binary", "chromatogramList", "cvParam", "userParam", "cvList", "cv",
    "mzML", "indexList", "indexListOffset", "fileChecksum", "indexedmzML",
)

#: Items of a metadata group, bound of a window number, and the default width of m/z windows.
GROUP_ITEMS, MAX_WINDOW, MZ_WIDTH = 8192, 1 << 20, 20.0

PARAM = T.StructType([T.StructField(n, T.StringType()) for n in ("cv_ref", "accession", "name", "value", "unit_cv_ref", "unit_name", "unit_accession")])
USER_PARAM = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "type", "unit_accession", "unit_cv_ref", "unit_name", "value")])

SPECTRA = T.StructType(
    [
        T.StructField("run_id", T.StringType()), T.StructField("spectrum_index", T.LongType()), T.StructField("id", T.StringType()), T.StructField("native_id", T.StringType()),
        T.StructField("scan_number", T.IntegerType()), T.StructField("ms_level", T.ShortType()), T.StructField("polarity", T.ShortType()), T.StructField("rt", T.DoubleType()),
        T.StructField("rt_unit", T.ShortType()), T.StructField("base_peak_mz", T.DoubleType()), T.StructField("base_peak_int", T.DoubleType()), T.StructField("total_ion_current", T.DoubleType()),
        T.StructField("selected_ion_mz", T.DoubleType()), T.StructField("position_x", T.IntegerType()), T.StructField("position_y", T.IntegerType()), T.StructField("position_z", T.IntegerType()),
    ]
)
SUMMARY_COLUMNS = tuple(SPECTRA.names[5:])
PEAKS = "run_id string, spectrum_index long, pos int, mz double, intensity double, mz_bin long"
EAV = "run_id string, section string, item_index long, row_no long, node_id long, parent_id long, tag short, cv short, accession long, unit_cv short, unit_accession long, value_kind short, num double, text string"


class SpectraError(Exception):
    """Base of the errors that operators raise."""


class OutOfRange(SpectraError, IndexError):
    pass


class BadRange(SpectraError, ValueError):
    pass


class BadChecksum(SpectraError):
    pass


class Malformed(SpectraError):
    pass


class Missing(Malformed):
    """A part that a read needs isn't there at all."""


class Unsupported(SpectraError):
    pass
