"""Byte and element functions that need numpy: half precision, byte transposition, deltas of bit patterns, array codecs."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMPY = {1: "<f8", 2: "<f4", 3: "<f2", 4: "<i2", 5: "<i4", 6: "<i8"}


def half_to_double(bits: Column) -> Column:
    """Doubles from arrays of half-precision bit patterns (short); infinities, NaN and subnormals as they are."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else np.asarray(a).astype(np.int16).view(np.float16).astype(np.float64))

    return run(bits)


def transpose_bytes(data: bytes, stride: int) -> bytes:
    """Byte planes of elements of `stride` bytes one after the other; a ragged tail is copied."""
    n = len(data) // stride * stride
    return np.frombuffer(data[:n], np.uint8).reshape(-1, stride).T.tobytes() + data[n:]


def restore_bytes(data: bytes, stride: int) -> bytes:
    n = len(data) // stride * stride
    return np.frombuffer(data[:n], np.uint8).reshape(stride, -1).T.tobytes() + data[n:]


def delta_bits(data: bytes, stride: int) -> bytes:
    """Wrapping differences of the elements' bit patterns; exact for every pattern."""
    x = np.frombuffer(data, f"<u{stride}")
    return np.diff(x, prepend=x.dtype.type(0)).astype(x.dtype).tobytes()


def sum_bits(data: bytes, stride: int) -> bytes:
    return np.cumsum(np.frombuffer(data, f"<u{stride}"), dtype=f"<u{stride}").tobytes()


def binary_function(f, *args):
    """A Column function of a binary column, by a function of bytes."""

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else f(bytes(b), *args))

    return run


def encode(values, dtype: int, compress: bool = False) -> str:
    """Text of an array: little-endian elements, deflated at level 6 if asked, in base64."""
    raw = np.asarray(values, np.float64 if dtype in (1, 2, 3) else np.int64).astype(NUMPY[dtype]).tobytes()
    return base64.b64encode(zlib.compress(raw, 6) if compress else raw).decode()


def limited_size(size: Column, packed: Column, most: int = 2 << 30, ratio: int = 32768) -> Column:
    """size, unless a block would unpack to more than `most` bytes or `ratio` times its own size; then raises."""
    bad = (size > most) | (size > packed * ratio)
    return F.when(bad, F.raise_error(F.lit("decompression limit")).cast("long")).otherwise(size)
