"""Scalar functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

U32 = 4294967295


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def window_index(mz: Column, width: float | Column = S.MZ_WIDTH) -> Column:
    """Number of the m/z window: floor(mz / width), at least 0 and at most 2**32 - 1; NaN, null and non-positive give 0."""
    width = F.lit(width) if not isinstance(width, Column) else width
    ok = (width > 0) & (mz > 0) & ~F.isnan(mz)
    return F.when(ok, F.least(F.floor(F.least(mz / width, F.lit(float(U32)))), F.lit(U32))).otherwise(F.lit(0)).cast("long")


def accession_tail(accession: Column) -> Column:
    """Digits behind the last colon as a number; without digits, or beyond 32 bits, 0."""
    digits = F.ltrim(F.regexp_replace(F.substring_index(accession, ":", -1), "[^0-9]", ""), F.lit("0"))
    number = F.when(F.length(digits).between(1, 10), digits.try_cast("long"))
    return F.coalesce(F.when(number <= U32, number), F.lit(0)).cast("long")


def accession_prefix_code(prefix: Column) -> Column:
    out = F.lit(S.CV_UNKNOWN)
    for name, code in reversed(S.CV_CODES.items()):
        out = F.when(prefix == name, F.lit(code)).otherwise(out)
    return out.cast("short")


def accession_code_prefix(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in S.CV_CODES.items():
        out = F.when(code == value, F.lit(name)).otherwise(out)
    return out


def tag_name(code: Column) -> Column:
    """The element of a tag code; null for unknown ones."""
    return F.get(F.array(*(F.lit(t) for t in S.TAGS)), code.cast("int"))


def normal_ms_tail(tail: Column) -> Column:
    """Tails below a million get a million added; 0 stays."""
    return F.when((tail > 0) & (tail < 1_000_000), tail + 1_000_000).otherwise(tail).cast("long")


def accession_text(code: Column, tail: Column) -> Column:
    """The written accession of a vocabulary code and number; null for codes without one."""
    seven = lambda prefix, n: F.concat(F.lit(prefix + ":"), F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(7)), F.lit("0")))
    return (
        F.when(code == 0, seven("MS", normal_ms_tail(tail)))
        .when(code == 1, seven("UO", tail))
        .when(code == 2, F.concat(F.lit("NCIT:C"), tail.cast("string")))
        .when(code == 4, F.concat(F.lit("ATTR:"), tail.cast("string")))
        .when(code == 5, seven("IMS", tail))
    )


def time_unit(accession: Column, name: Column) -> Column:
    """Code of a unit of time: by accession, else by name in singular or plural."""
    by = F.lower(name)
    return (
        F.when(accession == "UO:0000010", F.lit(S.UNIT_SECOND))
        .when(accession == "UO:0000031", F.lit(S.UNIT_MINUTE))
        .when(accession == "UO:0000028", F.lit(S.UNIT_MILLISECOND))
        .when(by.isin("second", "seconds"), F.lit(S.UNIT_SECOND))
        .when(by.isin("minute", "minutes"), F.lit(S.UNIT_MINUTE))
        .when(by.isin("millisecond", "milliseconds"), F.lit(S.UNIT_MILLISECOND))
        .otherwise(F.lit(S.UNIT_OTHER))
        .cast("short")
    )


def seconds(rt: Column, unit: Column) -> Column:
    return F.when(unit == S.UNIT_MINUTE, rt * 60).when(unit == S.UNIT_MILLISECOND, rt / 1000).otherwise(rt)


def dtype_code(name: Column) -> Column:
    out = F.lit(None).cast("short")
    for k, v in S.DTYPE_CODES.items():
        out = F.when(name == k, F.lit(v).cast("short")).otherwise(out)
    return out


def dtype_bytes(code: Column) -> Column:
    """Bytes of an element; an unknown code raises."""
    out = F.raise_error(F.concat(F.lit("unknown element type "), code.cast("string"))).cast("int")
    for k, v in S.DTYPE_BYTES.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def level_bucket(level: Column) -> Column:
    """The compression level that is used for a requested one: 1, 9, 12 or 22; above 22 raises."""
    return (
        F.when(level <= 5, F.lit(1)).when(level <= 10, F.lit(9)).when(level <= 16, F.lit(12)).when(level <= 22, F.lit(22))
        .otherwise(F.raise_error(F.lit("compression level above 22")).cast("int"))
    )


def value_kind(text: Column, is_attribute: Column | None = None) -> Column:
    """Kind of a metadata value: empty, number (canonical decimals with a point only) or text."""
    number = text.rlike(r"^-?(0|[1-9][0-9]*)\.([0-9]*[1-9])$") & (F.length(text) <= 17) & ~text.rlike(r"^-0\.0*$")
    if is_attribute is not None:
        number = number & ~is_attribute
    return F.when(text.isNull() | (text == ""), F.lit(S.VALUE_EMPTY)).when(number, F.lit(S.VALUE_NUMBER)).otherwise(F.lit(S.VALUE_TEXT)).cast("short")


def pack_user_param(name: Column, value: Column, kind: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(empty(name), F.lit("\0"), empty(value), F.lit("\0"), empty(kind))


def unpack_user_param(text: Column) -> Column:
    parts = F.split(text, "\0", 3)
    part = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    return F.struct(part(0).alias("name"), part(1).alias("value"), part(2).alias("type"))


def illegal_xml(text: Column) -> Column:
    """Whether a text has control characters that XML does not allow."""
    return text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def node_id(item: Column, stride: Column, local: Column) -> Column:
    """Node number in a joined tree: the root is shared, others move by item; above 32 bits raises."""
    moved = item * stride + local
    return F.when(local == 1, F.lit(1)).when(moved > U32, F.raise_error(F.lit("node id overflow")).cast("long")).otherwise(moved).cast("long")


def narrow(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("float"))


def widen(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def first_array(arrays: Column, accession: int) -> Column:
    """Values of the first array of a kind, in double precision; empty if there is none."""
    found = F.get(F.filter(arrays, lambda a: a["accession"] == accession), F.lit(0))["values"]
    return F.coalesce(widen(found), F.array().cast("array<double>"))


def name_matches(name: Column, pattern: str) -> Column:
    """Pattern of file names: alternatives by `|`, each all of its parts by `&`, as substrings in any case."""
    if not pattern.strip():
        raise ValueError("empty pattern")
    out = None
    for branch in pattern.split("|"):
        every = F.lit(True)
        for part in branch.split("&"):
            if part.strip():
                every = every & F.lower(name).contains(part.strip().lower())
        out = every if out is None else out | every
    return out


def name_filter(name: Column, pattern: str | None = None, exact: str | None = None, regex: str | None = None) -> Column:
    """One of the three ways to choose names, or all names."""
    if sum(x is not None for x in (pattern, exact, regex)) > 1:
        raise ValueError("pattern, exact and regex exclude each other")
    if pattern is not None:
        return name_matches(name, pattern)
    return name == exact if exact is not None else name.rlike(regex) if regex is not None else F.lit(True)


def narrowed(value: Column) -> Column:
    """A double as it is after it was stored in single precision."""
    return value.cast("float").cast("double")


def checksum_text(data: Column) -> Column:
    """SHA-1 of bytes or UTF-8 text, as documents state it: lowercase hexadecimal."""
    return F.sha1(data)


def to_base64(data: Column) -> Column:
    """Base64 without line breaks, as array text has it; text counts as UTF-8."""
    return F.regexp_replace(F.base64(data), "[\\r\\n]", "")


def from_base64(text: Column) -> Column:
    """Bytes of base64 text; white space within it is left out."""
    return F.unbase64(F.regexp_replace(text, "\\s", ""))


def positive(value: float, what: str) -> float:
    if not (0 < value < float("inf")):
        raise ValueError(f"{what} must be finite and above 0")
    return value
