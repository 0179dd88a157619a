"""The binary run format (block-structured, random access) as DataFrames.

A file has a header of 1024 bytes, blocks of array segments, summary, index and address tables, grouped metadata and
window directories; the header holds every section's place, length and checksum. `RunFile` reads through a function of
(offset, length), so a file, a buffer or a remote store can be behind it, and reads no more than what is asked for.
`RunFileSource` is a Spark data source on top: tables by option, spectra in partitions of index ranges.
"""

from __future__ import annotations

import json
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import schema as S
from ..functions import arrays as A
from ..functions import elements as E

#: Marks at the begin and the end of files that are written here. Readers also take other marks of eight bytes each,
#: of files with the same layout, as (signature, trailer).
SIGNATURE, TRAILER = b"SPFRUN\0\0", b"\0\0NURFPS"
# Sizes, and the places of the header's fields.
HEADER_BYTES = 1024
SECTIONS = ("A0", "A1", "A2", "A3", "B0", "B1", "B2", "B3", "C", "D", "E", "spectra", "chromatograms")
COUNTS = (
    "spectrum_blocks", "chromatogram_blocks", "n_spectra", "n_chromatograms", "spectrum_kinds", "chromatogram_kinds", "C_rows", "C_numbers", "C_texts", "D_rows", "D_numbers", "D_texts",
    "E_rows", "E_numbers", "E_texts", "C_plain", "D_plain", "E_plain", "A0_plain", "B0_plain", "file_size", "group_items", "C_groups", "D_groups",
)
CHECKSUMS = ("A0", "A1", "A2", "A3", "B0", "B1", "B2", "B3", "spectra", "chromatograms", "C", "D", "E")
A1 = np.dtype({"names": ["rt", "base_peak_mz", "selected_ion_mz", "base_peak_int", "total_ion_current", "ms_level", "polarity", "position_x", "position_y", "position_z", "rt_unit"],
               "formats": ["<f8"] * 5 + ["u1"] * 2 + ["<u4"] * 3 + ["u1"], "offsets": [0, 8, 16, 24, 32, 40, 41, 42, 46, 50, 54], "itemsize": 80})
B1 = np.dtype({"names": ["lowest_mz", "highest_mz", "lowest_wavelength", "highest_wavelength", "lowest_ion_mobility", "highest_ion_mobility", "polarity"],
               "formats": ["<f8"] * 6 + ["u1"], "offsets": [0, 8, 16, 24, 32, 40, 48], "itemsize": 80})
SLICE = np.dtype([("first", "<u8"), ("count", "<u8")])
ADDRESS = np.dtype([("offset", "<u8"), ("count", "<u8"), ("block", "<u4"), ("accession", "<u4"), ("dtype", "u1"), ("filter", "u1"), ("encoded", "<u4"), ("continues", "u1"), ("cv", "u1")])
DIRECTORY = np.dtype([("offset", "<u8"), ("size", "<u8"), ("plain", "<u8"), ("crc", "<u4"), ("reserved", "<u4")])
RAW, SHUFFLE, DELTA = 0, 1, 2
NONE, ZSTD = 0, 1
MOST_BYTES, MOST_RATIO = 2 << 30, 32768


@dataclass
class Header:
    """Fields of a header, by name; sections are (offset, length)."""

    version: int = 1
    codec: int = ZSTD
    level: int = 12
    filter: int = SHUFFLE
    block_size: int = 1 << 20
    mz_width: int = 20
    sections: dict[str, tuple[int, int]] = field(default_factory=lambda: dict.fromkeys(SECTIONS, (0, 0)))
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))
    checksums: dict[str, int] = field(default_factory=lambda: dict.fromkeys(CHECKSUMS, 0))

    def pack(self) -> bytes:
        out = bytearray(HEADER_BYTES)
        out[0:8] = SIGNATURE
        out[9:11] = self.version.to_bytes(2, "little")
        out[11:14] = bytes([self.codec, self.level, self.filter])
        out[16:24] = self.block_size.to_bytes(8, "little")
        out[24:28] = self.mz_width.to_bytes(4, "little")
        out[32:240] = np.array([x for s in SECTIONS for x in self.sections[s]], "<u8").tobytes()
        out[240:432] = np.array([self.counts[c] for c in COUNTS], "<u8").tobytes()
        out[968:1020] = np.array([self.checksums[c] for c in CHECKSUMS], "<u4").tobytes()
        out[1020:1024] = zlib.crc32(bytes(out[:1020])).to_bytes(4, "little")
        return bytes(out)

    @classmethod
    def parse(cls, raw: bytes, signature: bytes = SIGNATURE) -> Header:
        """Checks, in this order: size, signature, endianness, version, codec and level, reserved bytes, checksum."""
        if len(raw) < HEADER_BYTES:
            raise S.Malformed("header too short")
        if raw[:8] != signature:
            raise S.Malformed("bad signature")
        if raw[8]:
            raise S.Unsupported("not little-endian")
        version = int.from_bytes(raw[9:11], "little")
        if version > 1:
            raise S.Unsupported(f"format version {version}")
        codec, level, packing = raw[11:14]
        if codec > ZSTD or level > 22 or (codec == NONE) != (level == 0):
            raise S.Unsupported(f"codec {codec} at level {level}")
        if packing > DELTA:
            raise S.Unsupported(f"filter {packing}")
        if any(raw[14:16]) or any(raw[28:32]) or any(raw[432:968]):
            raise S.Malformed("reserved bytes are not zero")
        if zlib.crc32(raw[:1020]) != int.from_bytes(raw[1020:1024], "little"):
            raise S.BadChecksum("header")
        places = np.frombuffer(raw[32:240], "<u8").tolist()
        return cls(
            version, codec, level, packing, int.from_bytes(raw[16:24], "little"), int.from_bytes(raw[24:28], "little"),
            {s: (places[2 * i], places[2 * i + 1]) for i, s in enumerate(SECTIONS)},
            dict(zip(COUNTS, np.frombuffer(raw[240:432], "<u8").tolist())), dict(zip(CHECKSUMS, np.frombuffer(raw[968:1020], "<u4").tolist())),
        )


def unpack(raw: bytes, plain: int, codec: int, most: int = MOST_BYTES) -> bytes:
    """Plain bytes of a stored piece, within the limits of size and ratio."""
    if codec == NONE:
        return raw
    if plain > most or plain > max(1, len(raw)) * MOST_RATIO:
        raise S.Malformed("decompression limit")
    import zstandard

    out = zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(plain, 1)) if raw else b""
    if len(out) != plain:
        raise S.Malformed("unexpected size after decompression")
    return out


class RunFile:
    """A file, through read(offset, length) -> bytes; size may be unknown (None) for remote stores."""

    def __init__(self, read: Callable[[int, int], bytes], size: int | None = None, verify: bool = True, most: int = MOST_BYTES, marks: tuple[bytes, bytes] = (SIGNATURE, TRAILER), cache_bytes: int = 256 << 20) -> None:
        self._read, self.size, self.verify, self.most, self.trailer = read, size, verify, most, marks[1]
        self.header = h = Header.parse(self.read(0, HEADER_BYTES), marks[0])
        if size is not None:
            if h.counts["file_size"] != size:
                raise S.Malformed("file size differs from the header")
            self.check_layout()
        n, m = h.counts["n_spectra"], h.counts["n_chromatograms"]
        self.a1, self.a2 = self.table("A1", A1, n), self.table("A2", SLICE, n)
        self.b1, self.b2 = self.table("B1", B1, m), self.table("B2", SLICE, m)
        top = lambda t: int((t["first"] + t["count"]).max()) if len(t) else 0
        self.a3, self.b3 = self.table("A3", ADDRESS, top(self.a2)), self.table("B3", ADDRESS, top(self.b2))
        for t in (self.a3, self.b3):
            if not np.isin(t["dtype"], list(S.DTYPE_BYTES)).all():
                raise S.Unsupported("unknown element type")
        self.blocks = {k: self._directory(k, f"{k[:-1] if k == 'chromatograms' else 'spectrum'}_blocks") for k in ("spectra", "chromatograms")}
        self.cache, self.cache_bytes, self.cached, self.directories = OrderedDict(), cache_bytes, 0, {}

    @classmethod
    def open(cls, path: str, **options) -> RunFile:
        import os

        def read(offset: int, length: int) -> bytes:
            with open(path, "rb") as f:
                f.seek(offset)
                return f.read(length)

        return cls(read, os.path.getsize(path), **options)

    @classmethod
    def of_bytes(cls, data: bytes, **options) -> RunFile:
        return cls(lambda offset, length: data[offset : offset + length], len(data), **options)

    def read(self, offset: int, length: int) -> bytes:
        out = self._read(offset, length) if length else b""
        if len(out) != length:
            raise S.Malformed(f"{len(out)} of {length} bytes at {offset}")
        return out

    def check_layout(self) -> None:
        """Sections stand behind the header, on 8-byte bounds, within the file, and apart from each other."""
        end = HEADER_BYTES
        for offset, length in sorted(x for x in self.header.sections.values() if x[1]):
            if offset < end or offset % 8 or offset + length > self.size:
                raise S.Malformed(f"section at {offset}")
            end = offset + length
        s, c = self.header.sections, self.header.counts
        for name, count in (("spectra", "spectrum_blocks"), ("chromatograms", "chromatogram_blocks"), ("C", "C_groups"), ("D", "D_groups")):
            if c[count] * DIRECTORY.itemsize > s[name][1]:
                raise S.Malformed(f"{name}: more entries than its section can hold")
        for name, count in (("C", "n_spectra"), ("D", "n_chromatograms")):
            if c["group_items"] and c[f"{name}_groups"] != -(-c[count] // c["group_items"]):
                raise S.Malformed(f"{name}: groups differ from the number of items")
        if self.read(self.size - 8, 8) != self.trailer:
            raise S.Malformed("bad trailer")

    def _checked(self, raw: bytes, crc: int, what: str) -> bytes:
        if self.verify and zlib.crc32(raw) != crc:
            raise S.BadChecksum(what)
        return raw

    def section(self, name: str) -> bytes:
        return self._checked(self.read(*self.header.sections[name]), self.header.checksums[name], name)

    def table(self, name: str, dtype: np.dtype, n: int) -> np.ndarray:
        raw = self.section(name)
        return np.frombuffer(unpack(raw, n * dtype.itemsize, self.header.codec, self.most) if n else b"", dtype)

    def _directory(self, name: str, count: str) -> np.ndarray:
        offset, length = self.header.sections[name]
        size = self.header.counts[count] * DIRECTORY.itemsize
        if size > length:
            raise S.Malformed(f"{name}: directory larger than its container")
        raw = self._checked(self.read(offset + length - size, size), self.header.checksums[name], f"{name} directory") if size else b""
        return np.frombuffer(raw, DIRECTORY)

    def block(self, name: str, number: int, stride: int) -> bytes:
        """A plain block, from the cache of the blocks read last, which holds up to `cache_bytes`."""
        key = (name, number, stride)
        if key in self.cache:
            self.cache.move_to_end(key)
            return self.cache[key]
        out = self.cache[key] = self._block(name, number, stride)
        self.cached += len(out)
        while self.cached > self.cache_bytes and len(self.cache) > 1:
            self.cached -= len(self.cache.popitem(last=False)[1])
        return out

    def _block(self, name: str, number: int, stride: int) -> bytes:
        if number >= len(self.blocks[name]):
            raise S.OutOfRange(f"block {number}")
        d = self.blocks[name][number]
        raw = self._checked(self.read(self.header.sections[name][0] + int(d["offset"]), int(d["size"])), int(d["crc"]), f"{name} block {number}")
        plain = unpack(raw, int(d["plain"]), self.header.codec, self.most)
        return A.restore_bytes(plain, stride) if self.header.filter == SHUFFLE and stride > 1 else plain

    def segment(self, name: str, a: np.void) -> np.ndarray:
        code, stride = int(a["dtype"]), S.DTYPE_BYTES[int(a["dtype"])]
        data = self.block(name, int(a["block"]), stride)
        lo, hi = int(a["offset"]) * stride, (int(a["offset"]) + int(a["count"])) * stride
        if hi > len(data):
            raise S.Malformed(f"segment beyond block {int(a['block'])}")
        data = data[lo:hi]
        if a["filter"] != RAW:
            if code > 2:
                raise S.Unsupported("filter of an integer array")
            data = A.sum_bits(data, stride) if a["filter"] == DELTA else A.restore_bytes(data, stride)
        return np.frombuffer(data, A.NUMPY[code])

    def arrays(self, index: int, chromatogram: bool = False) -> list[dict]:
        """Arrays of an item, segments joined: accession, vocabulary code, element type, values."""
        slices, table, name = (self.b2, self.b3, "chromatograms") if chromatogram else (self.a2, self.a3, "spectra")
        if not 0 <= index < len(slices):
            raise S.OutOfRange(f"item {index}")
        first, count = int(slices[index]["first"]), int(slices[index]["count"])
        if first + count > len(table):
            raise S.Malformed("addresses beyond their table")
        out: list[dict] = []
        for a in table[first : first + count]:
            if a["continues"] > 1 or (a["continues"] and not out):
                raise S.Malformed("bad continuation flag")
            if a["continues"]:
                last = out[-1]
                if (last["accession"], last["dtype"], last["filter"]) != (a["accession"], a["dtype"], a["filter"]):
                    raise S.Malformed("segments of one array differ")
                last["parts"].append(self.segment(name, a))
            else:
                out.append({"accession": int(a["accession"]), "cv": int(a["cv"]), "dtype": int(a["dtype"]), "filter": int(a["filter"]), "parts": [self.segment(name, a)]})
        return [{"accession": x["accession"], "cv": x["cv"], "dtype": x["dtype"], "values": np.concatenate(x["parts"])} for x in out]

    def values(self, index: int, kind: int | str, chromatogram: bool = False) -> np.ndarray:
        """The first array of a kind in double precision; empty if there is none."""
        accession = S.AXES.get(kind, kind)
        return next((x["values"].astype(np.float64) for x in self.arrays(index, chromatogram) if x["accession"] == accession), np.zeros(0))

    def windows(self, name: str = "A0") -> dict[str, np.ndarray]:
        """The window directory, read once: starts, items, and address rows of both axes; missing or malformed raises."""
        if name not in self.directories:
            self.directories[name] = self._windows(name)
        return self.directories[name]

    def _windows(self, name: str) -> dict[str, np.ndarray]:
        length = self.header.sections[name][1]
        if not length:
            raise S.Missing(f"{name} is missing")
        x = np.frombuffer(unpack(self.section(name), self.header.counts[f"{name}_plain"], self.header.codec, self.most), "<u4")
        if len(x) < 2 or len(x) != 3 + int(x[0]) + 3 * int(x[1]):
            raise S.Malformed(name)
        n, m = int(x[0]), int(x[1])
        starts, rest = x[2 : 3 + n], x[3 + n :].reshape(3, m)
        rise = np.diff(rest[0].astype(np.int64))
        inner = np.ones(max(m - 1, 0), bool)
        inner[starts[(starts > 0) & (starts < m)].astype(np.int64) - 1] = False
        if starts[0] or starts[-1] != m or (np.diff(starts.astype(np.int64)) < 0).any() or (rise[inner] <= 0).any():
            raise S.Malformed(f"{name} structure")
        return {"starts": starts, "item": rest[0], "x_address": rest[1], "y_address": rest[2]}

    def metadata(self, name: str) -> Iterator[tuple]:
        """Rows (item_index, row_no, node_id, parent_id, tag, cv, accession, unit_cv, unit_accession, value_kind, num, text)
        of a grouped section; node numbers are unique within a group, with the list's own node shared."""
        offset, length = self.header.sections[name]
        count = self.header.counts[f"{name}_groups"]
        size = count * DIRECTORY.itemsize
        directory = np.frombuffer(self.read(offset + length - size, size), DIRECTORY)
        total, base = [0, 0, 0], 0
        n_items = self.header.counts["n_spectra" if name == "C" else "n_chromatograms"]
        for d in directory:
            raw = self._checked(self.read(offset + int(d["offset"]), int(d["size"])), int(d["crc"]), f"{name} group")
            body = unpack(raw, int(d["plain"]), self.header.codec, self.most)
            counts = np.frombuffer(body[:12], "<u4").tolist()
            total = [a + b for a, b in zip(total, counts)]
            items = min(self.header.counts["group_items"], n_items - base)
            yield from metadata_rows(body[12:], items, *counts, base=base, remap=True)
            base += items
        if total != [self.header.counts[f"{name}_{k}"] for k in ("rows", "numbers", "texts")]:
            raise S.Malformed(f"{name}: totals differ from the header")

    def metadata_of(self, index: int, name: str = "C") -> list[tuple]:
        """Rows of one item, of which only its group is read; node numbers are those within the group, without the list's."""
        offset, size = self.metadata_range(index, name)
        start, length = self.header.sections[name]
        count = self.header.counts[f"{name}_groups"]
        g = index // max(1, self.header.counts["group_items"])
        d = np.frombuffer(self.read(start + length - (count - g) * DIRECTORY.itemsize, DIRECTORY.itemsize), DIRECTORY)[0]
        body = unpack(self._checked(self.read(offset, size), int(d["crc"]), f"{name} group"), int(d["plain"]), self.header.codec, self.most)
        n, base = self.header.counts["n_spectra" if name == "C" else "n_chromatograms"], g * self.header.counts["group_items"]
        if index >= n:
            raise S.OutOfRange(f"item {index}")
        rows = metadata_rows(body[12:], min(self.header.counts["group_items"], n - base), *np.frombuffer(body[:12], "<u4").tolist(), base=base)
        return [r for r in rows if r[0] == index and r[2] != 1]

    def element(self, index: int, name: str = "C", names: dict[str, str] | None = None) -> dict:
        """The nested value of one item."""
        return next(v for _, v in E.assembled(_plain_rows(self.metadata_of(index, name)), names))

    def global_metadata(self) -> Iterator[tuple]:
        """Rows of the run's own metadata, in the form of `metadata`; node numbers are as stored."""
        c = self.header.counts
        if not self.header.sections["E"][1]:
            return
        body = unpack(self.section("E"), c["E_plain"], self.header.codec, self.most)
        items = int(np.frombuffer(body[:18], "<u2").sum())
        yield from metadata_rows(body[32:], items, c["E_rows"], c["E_numbers"], c["E_texts"])

    # nested values

    def elements(self, name: str, names: dict[str, str] | None = None) -> Iterator[tuple[int, str, dict]]:
        """(item, tag, value) of the items of C or D, in the current form; names: of accessions, which files do not hold."""
        held: list[tuple] = []
        item = None
        for row in (*self.metadata(name), (None,)):
            if row[0] != item and held:
                # The list's own node comes with the first item of a group, and is no part of the item.
                own = [r for r in held if r[2] != 1]
                for tag, value in E.assembled(_plain_rows(own), names):
                    yield item, tag, value
                held = []
            item = row[0]
            held.append(row)

    def head(self, names: dict[str, str] | None = None) -> Iterator[tuple[str, dict]]:
        """(tag, value) of what the run holds beside its items: head elements, the run, and lists' attributes."""
        lists: dict[str, dict] = {}
        for tag, value in E.assembled(_plain_rows(list(self.global_metadata())), names):
            holder = HOLDERS.get(tag)
            if holder == tag:
                yield tag, value
            elif holder:
                lists.setdefault(holder, {}).setdefault(tag, []).append(value)
        yield from lists.items()

    # range reads, and what they would read

    def _window_span(self, lo: float, hi: float, n: int) -> range:
        if not (np.isfinite(lo) and np.isfinite(hi)) or lo > hi:
            raise S.BadRange(f"bad range {lo}..{hi}")
        of = lambda x: int(x // self.header.mz_width) if x > 0 else 0
        return range(min(of(lo), n), min(of(hi), n - 1) + 1)

    def _entry(self, w: dict[str, np.ndarray], window: int, index: int) -> int | None:
        """The place of a spectrum's entry in a window of the directory, whose entries are sorted by spectrum."""
        lo, hi = int(w["starts"][window]), int(w["starts"][window + 1])
        e = lo + int(np.searchsorted(w["item"][lo:hi], index))
        return e if e < hi and w["item"][e] == index else None

    def in_range(self, index: int, lo: float, hi: float, x: int | str = "mz", y: int | str = "intensity") -> tuple[np.ndarray, np.ndarray]:
        """x and y of a spectrum with x in the range, both ends inside.

        Of a spectrum that is split by windows only the windows of the range are read; others are read whole, whatever
        windows they are filed under.
        """
        if not (np.isfinite(lo) and np.isfinite(hi)) or lo > hi:
            raise S.BadRange(f"bad range {lo}..{hi}")
        if not 0 <= index < len(self.a2):
            raise S.OutOfRange(f"item {index}")
        a, b = self._split(index, lo, hi) if (S.AXES.get(x, x), S.AXES.get(y, y)) == (S.MZ, S.INTENSITY) else (None, None)
        if a is None:
            a, b = self.values(index, x), self.values(index, y)
        n = min(len(a), len(b))
        keep = (a[:n] >= lo) & (a[:n] <= hi)
        return a[:n][keep], b[:n][keep]

    def _split(self, index: int, lo: float, hi: float) -> tuple[np.ndarray | None, np.ndarray | None]:
        """m/z and intensity of the windows of a range, if the spectrum has several; else nothing."""
        first, count = int(self.a2[index]["first"]), int(self.a2[index]["count"])
        rows = self.a3[first : first + count]
        number = np.cumsum(rows["continues"] == 0)
        of = lambda k: next((number == number[i] for i in np.flatnonzero(rows["accession"] == k)), np.zeros(len(rows), bool))
        mz, intensity = of(S.MZ), of(S.INTENSITY)
        if mz.sum() < 2 or mz.sum() != intensity.sum() or (rows["count"][mz] != rows["count"][intensity]).any() or not self.header.sections["A0"][1]:
            return None, None
        w = self.windows()
        found = [e for b in self._window_span(lo, hi, len(w["starts"]) - 1) if (e := self._entry(w, b, index)) is not None]
        read = lambda c: [self.segment("spectra", self.a3[int(w[c][e])]).astype(np.float64) for e in found]
        return np.concatenate([np.zeros(0), *read("x_address")]), np.concatenate([np.zeros(0), *read("y_address")])

    def _block_range(self, number: int, name: str = "spectra") -> tuple[int, int]:
        d = self.blocks[name][number]
        return self.header.sections[name][0] + int(d["offset"]), int(d["size"])

    def byte_ranges(self, index: int, mz: tuple[float, float] | None = None, arrays: tuple = (S.MZ, S.INTENSITY)) -> list[tuple[int, int]]:
        """Ranges (offset, length) of the blocks with a spectrum's arrays, sorted; with mz only those of its windows.

        Arrays that are not split like m/z are read whole; unknown kinds add nothing.
        """
        if not 0 <= index < len(self.a2):
            raise S.OutOfRange(f"item {index}")
        kinds = [S.AXES.get(k, k) for k in arrays]
        first, count = int(self.a2[index]["first"]), int(self.a2[index]["count"])
        rows = self.a3[first : first + count]
        number = np.cumsum(rows["continues"] == 0)
        sizes = {n: tuple(rows["count"][number == n]) for n in np.unique(number)}
        axis = next((sizes[n] for n in sizes if rows["accession"][number == n][0] == S.MZ), None)
        wanted: set[int] = set()
        inside = None
        if mz is not None:
            w = self.windows()
            span = self._window_span(*mz, len(w["starts"]) - 1)
            inside = {int(w["x_address"][e]) - first for b in span if (e := self._entry(w, b, index)) is not None}
            base = next((i for i, r in enumerate(rows) if r["accession"] == S.MZ), 0)
            inside = {i - base for i in inside}
        for n, own in sizes.items():
            at = np.flatnonzero(number == n)
            if rows["accession"][at[0]] not in kinds:
                continue
            for k, i in enumerate(at):
                if inside is None or own != axis or k in inside:
                    wanted.add(int(rows["block"][i]))
        return sorted(self._block_range(b) for b in wanted)

    def extracted_ion_ranges(self, mz: tuple[float, float], rt: tuple[float, float] | None = None, gap: int = 0) -> list[tuple[int, int]]:
        """Merged ranges of the blocks that an extracted-ion read of all spectra needs; spectra with NaN rt are read."""
        w = self.windows()
        wanted: set[int] = set()
        for b in self._window_span(*mz, len(w["starts"]) - 1):
            e = slice(int(w["starts"][b]), int(w["starts"][b + 1]))
            t = self.a1["rt"][w["item"][e]]
            keep = np.ones(len(t), bool) if rt is None else ~((t < rt[0]) | (t > rt[1]))
            for c in ("x_address", "y_address"):
                wanted.update(self.a3["block"][w[c][e][keep]].tolist())
        return merge(sorted(self._block_range(b) for b in wanted), gap)

    def metadata_range(self, index: int, name: str = "C") -> tuple[int, int]:
        """The range of the metadata group that holds an item."""
        offset, length = self.header.sections[name]
        count, size = self.header.counts[f"{name}_groups"], DIRECTORY.itemsize
        g = index // max(1, self.header.counts["group_items"])
        if not 0 <= g < count:
            raise S.OutOfRange(f"item {index}")
        d = np.frombuffer(self.read(offset + length - (count - g) * size, size), DIRECTORY)[0]
        return offset + int(d["offset"]), int(d["size"])

    def touched(self) -> list[tuple[str, int, int]]:
        """Ranges that opening and the first range read take: header, tables, directories and trailer."""
        s, c = self.header.sections, self.header.counts
        out = [("header", 0, HEADER_BYTES), *((k, *s[k]) for k in ("A0", "A1", "A2", "A3", "B0", "B1", "B2", "B3"))]
        for k, n in (("spectra", "spectrum_blocks"), ("chromatograms", "chromatogram_blocks"), ("C", "C_groups"), ("D", "D_groups")):
            size = c[n] * DIRECTORY.itemsize
            out.append((f"{k} directory", s[k][0] + s[k][1] - size, size))
        return [x for x in [*out, ("trailer", c["file_size"] - 8, 8)] if x[2]]


#: Items of the run's own metadata in the order of their counts, and the element that holds each.
GLOBAL = ("fileDescription", "run", "referenceableParamGroup", "sample", "instrumentConfiguration", "software", "dataProcessing", "scanSettings", "cv")
HOLDERS = {
    "fileDescription": "fileDescription", "run": "run", "referenceableParamGroup": "referenceableParamGroupList", "sample": "sampleList", "instrumentConfiguration": "instrumentConfigurationList",
    "software": "softwareList", "dataProcessing": "dataProcessingList", "scanSettings": "scanSettingsList", "cv": "cvList", "sampleList": "sampleList",
}


def _plain_rows(stored: list[tuple]) -> list[tuple]:
    """Rows of `metadata` as `elements.assembled` takes them: numbers as text again."""
    return [(r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[11] if r[10] is None else np.format_float_positional(r[10], trim="-")) for r in stored]


def merge(ranges: list[tuple[int, int]], gap: int = 0) -> list[tuple[int, int]]:
    """Sorted ranges joined where the next begins at most `gap` behind the end so far; empty ones are left out."""
    out: list[list[int]] = []
    for offset, length in ranges:
        if length and out and offset <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], offset + length)
        elif length:
            out.append([offset, offset + length])
    return [(a, b - a) for a, b in out]


def metadata_rows(body: bytes, items: int, rows: int, numbers: int, texts: int, base: int = 0, remap: bool = False) -> Iterator[tuple]:
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize * n
        if at + size > len(body):
            raise S.Malformed("metadata column beyond its group")
        out = np.frombuffer(body[at : at + size], kind)
        at += size
        return out

    index = take("<u4", items + 1).astype(np.int64)
    owner, parent = take("<u4", rows).astype(np.int64), take("<u4", rows).astype(np.int64)
    tag, cv, accession = take("u1", rows), take("u1", rows), take("<u4", rows)
    unit_cv, unit, kind = take("u1", rows), take("<u4", rows), take("u1", rows)
    number, sizes = take("<f8", numbers), take("<u4", texts).astype(np.int64)
    text = take("u1", int(sizes.sum())).tobytes()
    if index[0] or index[-1] != rows or (np.diff(index) < 0).any() or (kind == 0).sum() != numbers or (kind == 1).sum() != texts:
        raise S.Malformed("metadata structure")
    if remap and rows:
        stride = 1 + max(owner.max(), parent.max())
        item = np.repeat(np.arange(items), np.diff(index)) * stride
        owner, parent = (np.where(x == 1, 1, item + x) for x in (owner, parent))
        if max(owner.max(), parent.max()) > 0xFFFFFFFF:
            raise S.Malformed("node id overflow")
    ends = np.cumsum(sizes)
    n = t = 0
    for i in range(items):
        for k, r in enumerate(range(int(index[i]), int(index[i + 1]))):
            num = said = None
            if kind[r] == 0:
                num, n = float(number[n]), n + 1
            elif kind[r] == 1:
                said, t = text[ends[t] - sizes[t] : ends[t]].decode(), t + 1
            yield base + i, k, int(owner[r]), int(parent[r]), int(tag[r]), int(cv[r]), int(accession[r]), int(unit_cv[r]), int(unit[r]), int(kind[r]), num, said


# --- Spark ------------------------------------------------------------------------------------------------

_ARRAYS = "arrays array<struct<accession:bigint,cv:int,dtype:smallint,values:array<double>>>"
TABLES = {
    "spectra": "spectrum_index long, " + ", ".join(f"{n} double" for n in A1.names[:5]) + ", ms_level short, polarity short, position_x long, position_y long, position_z long, rt_unit short",
    "chromatograms": "chromatogram_index long, " + ", ".join(f"{n} double" for n in B1.names[:6]) + ", polarity short",
    "arrays": "spectrum_index long, " + _ARRAYS, "chromatogram_arrays": "chromatogram_index long, " + _ARRAYS,
    "segments": "row_no long, offset long, count long, block long, accession long, dtype short, filter short, encoded long, continues short, cv short",
    "blocks": "container string, block long, offset long, size long, plain long, crc long", "sections": "section string, offset long, length long", "open_ranges": "section string, offset long, length long",
    "windows": "mz_bin long, spectrum_index long, mz_address long, intensity_address long",
    "elements": "spectrum_index long, element string", "chromatogram_elements": "chromatogram_index long, element string", "head": "tag string, element string",
    "metadata": "section string, item_index long, row_no long, node_id long, parent_id long, tag int, cv int, accession long, unit_cv int, unit_accession long, value_kind int, num double, text string",
}


def table_rows(f: RunFile, table: str, lo: int = 0, hi: int | None = None) -> Iterator[tuple]:
    """Rows of a table of one file; lo and hi bound the item index of item tables."""
    own = lambda t, lo, hi: ((i, *(x.item() for x in t[i])) for i in range(lo, min(hi if hi is not None else len(t), len(t))))
    if table in ("spectra", "chromatograms"):
        yield from own(f.a1 if table == "spectra" else f.b1, lo, hi)
    elif table in ("arrays", "chromatogram_arrays"):
        chrom = table != "arrays"
        n = len(f.b2 if chrom else f.a2)
        for i in range(lo, min(n, hi if hi is not None else n)):
            yield i, [(x["accession"], x["cv"], x["dtype"], x["values"].astype(np.float64).tolist()) for x in f.arrays(i, chrom)]
    elif table == "segments":
        yield from own(f.a3, 0, None)
    elif table == "blocks":
        for name, d in f.blocks.items():
            yield from ((name, i, int(r["offset"]), int(r["size"]), int(r["plain"]), int(r["crc"])) for i, r in enumerate(d))
    elif table == "sections":
        yield from ((k, *v) for k, v in f.header.sections.items())
    elif table == "open_ranges":
        yield from f.touched()
    elif table == "windows":
        w = f.windows()
        bins = np.repeat(np.arange(len(w["starts"]) - 1), np.diff(w["starts"].astype(np.int64)))
        yield from zip(bins.tolist(), w["item"].tolist(), w["x_address"].tolist(), w["y_address"].tolist())
    elif table in ("elements", "chromatogram_elements"):
        name = "C" if table == "elements" else "D"
        if f.header.counts[f"{name}_groups"]:
            yield from ((i, json.dumps(value)) for i, _, value in f.elements(name))
    elif table == "head":
        yield from ((tag, json.dumps(value)) for tag, value in f.head())
    elif table == "metadata":
        for name in ("C", "D"):
            if f.header.counts[f"{name}_groups"]:
                yield from ((name, *r) for r in f.metadata(name))
        yield from (("E", *r) for r in f.global_metadata())
    else:
        raise S.Unsupported(f"table {table}")


@dataclass
class _Part(InputPartition):
    path: str
    lo: int
    hi: int


class RunFileSource(DataSource):
    """spark.read.format("runfile").option("table", ...).load(path) for files on a path that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "runfile"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "spectra")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        """Each run of a partition becomes one file; rows come as `sinks.runfile.rows` gives them."""
        return _FileWriter(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.table = options["path"], options.get("table", "spectra")
        self.verify, self.items = options.get("verify", "true") == "true", int(options.get("itemsPerPartition", 4096))
        # Marks of files that others wrote, each as hexadecimal digits.
        self.marks = tuple(bytes.fromhex(options[k]) if k in options else v for k, v in (("signature", SIGNATURE), ("trailer", TRAILER)))

    def partitions(self) -> list:
        import glob
        import os

        paths = sorted(p for p in glob.glob(os.path.join(self.path, "**", "*"), recursive=True) if not os.path.basename(p).startswith((".", "_"))) if os.path.isdir(self.path) else [self.path]
        out = []
        for p in (p for p in paths if os.path.isfile(p)):
            with open(p, "rb") as f:
                counts = Header.parse(f.read(HEADER_BYTES), self.marks[0]).counts
            n = {"arrays": counts["n_spectra"], "chromatogram_arrays": counts["n_chromatograms"], "spectra": counts["n_spectra"], "chromatograms": counts["n_chromatograms"]}.get(self.table)
            out += [_Part(p, lo, lo + self.items) for lo in range(0, n, self.items)] if n is not None else [_Part(p, 0, -1)]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        f = RunFile.open(partition.path, verify=self.verify, marks=self.marks)
        yield from table_rows(f, self.table, partition.lo, None if partition.hi < 0 else partition.hi)


@dataclass
class _Wrote(WriterCommitMessage):
    paths: list[str]


class _FileWriter(DataSourceWriter):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.options = {"level": int(options.get("level", 12)), "mz_width": float(options.get("mzWindow", S.MZ_WIDTH)), "force_f32": options.get("forceF32", "false") == "true", "block_size": int(options.get("blockSize", 1 << 20))}

    def write(self, iterator) -> WriterCommitMessage:
        import os
        import uuid

        from ..sinks import runfile as sink

        os.makedirs(self.path, exist_ok=True)
        # Rows come sorted (`sinks.runfile.rows`): of each run the head, spectra, chromatograms; none is held.
        paths = []
        for _, rows in groupby((r.asDict(recursive=True) for r in iterator), key=lambda r: r.get("source_path")):
            paths.append(os.path.join(self.path, f".{uuid.uuid4().hex}.run"))
            sink.write_rows(paths[-1], rows, **self.options)
        return _Wrote(paths)

    def commit(self, messages) -> None:
        import os

        for path in (p for m in messages if m for p in m.paths):  # files get their names when all tasks have written theirs
            folder, name = os.path.split(path)
            os.replace(path, os.path.join(folder, name[1:]))

    def abort(self, messages) -> None:
        import os

        for path in (p for m in messages if m for p in m.paths):
            if os.path.exists(path):
                os.remove(path)


def read_files(spark: SparkSession, path: str, table: str = "spectra", verify: bool = True, **options) -> DataFrame:
    """A table of files in any store that Spark reads: each file is one task's buffer. Adds the column source_path."""
    return read_contents(spark.read.format("binaryFile").load(path).select("path", "content"), table, verify, **options)


def read_contents(contents: DataFrame, table: str = "spectra", verify: bool = True, **options) -> DataFrame:
    """A table of files in contents(path, content)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = TABLES[table]
    schema = to_arrow_schema(StructType.fromDDL("source_path string, " + types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                f = RunFile.of_bytes(content, verify=verify, **options)
                held: list = []
                for row in table_rows(f, table):
                    held.append((path, *row))
                    if len(held) == 1000:
                        yield _batch(held, schema)
                        held = []
                if held:
                    yield _batch(held, schema)

    return contents.select("path", "content").mapInArrow(run, "source_path string, " + types)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = []
    for values, f in zip(zip(*rows), schema):
        if pa.types.is_list(f.type) and pa.types.is_struct(f.type.value_type):
            names = [x.name for x in f.type.value_type]
            values = [[dict(zip(names, x)) for x in v] for v in values]
        cols.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def check(path: str, marks: tuple[bytes, bytes] = (SIGNATURE, TRAILER)) -> list[tuple[int, str, bool]]:
    """(number, label, passed) of the checks of a file, each on its own; a file that can't be opened fails the later ones."""
    out: list[tuple[int, str, bool]] = []

    def one(label: str, f) -> bool:
        try:
            ok = f() is not False
        except (S.SpectraError, OSError, ValueError, IndexError, KeyError):
            ok = False
        out.append((len(out) + 1, label, ok))
        return ok

    with open(path, "rb") as raw:
        data = raw.read()
    head = data[:HEADER_BYTES]
    one("header is whole", lambda: len(head) == HEADER_BYTES)
    one("signature", lambda: head[:8] == marks[0])
    one("byte order", lambda: head[8] == 0)
    one("format version", lambda: int.from_bytes(head[9:11], "little") <= 1)
    one("codec and level", lambda: head[11] <= ZSTD and head[12] <= 22 and (head[11] == NONE) == (head[12] == 0))
    one("filter", lambda: head[13] <= DELTA)
    one("reserved bytes are zero", lambda: not any(head[14:16]) and not any(head[28:32]) and not any(head[432:968]))
    one("header checksum", lambda: zlib.crc32(head[:1020]) == int.from_bytes(head[1020:1024], "little"))
    header: Header | None = None
    if one("header", lambda: Header.parse(head, marks[0])):
        header = Header.parse(head, marks[0])
    sections = sorted(((k, *v) for k, v in header.sections.items() if v[1]), key=lambda x: x[1]) if header else []
    known = lambda f: (lambda: header is not None and f())
    one("file size", known(lambda: header.counts["file_size"] == len(data)))
    one("trailer", lambda: data[-8:] == marks[1])
    one("sections are aligned", known(lambda: all(o % 8 == 0 for _, o, _ in sections)))
    one("sections lie in the file", known(lambda: all(HEADER_BYTES <= o and o + n <= len(data) - 8 for _, o, n in sections)))
    one("sections lie apart", known(lambda: all(a[1] + a[2] <= b[1] for a, b in zip(sections, sections[1:]))))
    for name in ("A0", "A1", "A2", "A3", "B0", "B1", "B2", "B3", "E"):
        one(f"{name} checksum", known(lambda name=name: not header.sections[name][1] or zlib.crc32(data[header.sections[name][0] : sum(header.sections[name])]) == header.checksums[name]))
    f: RunFile | None = None
    if one("tables and directories", lambda: RunFile.of_bytes(data, marks=marks)):
        f = RunFile.of_bytes(data, marks=marks)
    opened = lambda g: (lambda: f is not None and g())
    one("element types", opened(lambda: all(np.isin(t["dtype"], list(S.DTYPE_BYTES)).all() for t in (f.a3, f.b3))))
    one("block numbers", opened(lambda: all((t["block"] < max(len(f.blocks[k]), 1)).all() for t, k in ((f.a3, "spectra"), (f.b3, "chromatograms")))))
    for name in ("spectra", "chromatograms"):
        one(f"{name} blocks", opened(lambda name=name: [f._block(name, i, 1) for i in range(len(f.blocks[name]))]))
    for name, of in (("A0", "spectra"), ("B0", "chromatograms")):
        one(f"{name} window directory", opened(lambda name=name, of=of: not f.header.sections[name][1] or bool((f.windows(name)["item"] < f.header.counts[f"n_{of}"]).all())))
    for name in ("C", "D"):
        one(f"{name} metadata", opened(lambda name=name: f.header.counts[f"{name}_groups"] == 0 or bool(list(f.metadata(name)))))
    one("E metadata", opened(lambda: list(f.global_metadata()) is not None))
    one("spectrum arrays", opened(lambda: [f.arrays(i) for i in range(len(f.a2))] is not None))
    one("chromatogram arrays", opened(lambda: [f.arrays(i, True) for i in range(len(f.b2))] is not None))
    one("m/z in order", opened(lambda: not any((np.diff(f.values(i, S.MZ)) < 0).any() for i in range(len(f.a2)))))
    one("rt in order", opened(lambda: not (np.diff(f.a1["rt"][np.isfinite(f.a1["rt"])]) < 0).any()))
    return out
