"""Runs as files of the binary run format: one task writes a file from front to back, the header last."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable
from typing import BinaryIO

import numpy as np

from .. import schema as S
from ..functions import arrays as A
from ..functions import elements as E
from ..sources import runfile as R

# Tags and attribute accessions of the rows that are written, and axes that are stored as differences.
TAG_SPECTRUM, TAG_CHROMATOGRAM, TAG_SPECTRUM_LIST, TAG_CHROMATOGRAM_LIST = 14, 24, 43, 51
ATTR_COUNT = 9_910_100
DELTA_AXES = frozenset([S.MZ, S.TIME, 1003007, 1002816, 1003008, 1003153])


#: Bytes of open blocks, at most.
PENDING = 64 << 20


class Writer:
    """Writes spectra, then chromatograms, then finishes. Items are dicts: id, params, arrays and summary values, and
    `element`, all that the item holds beside binary data (JSON; params are left aside then). head: values of the run's
    own elements by tag, in the current form, set at any time.

    m/z that falls, finite rt that falls, windows beyond the bound, and a spectrum after a chromatogram raise.
    """

    def __init__(self, out: BinaryIO, level: int = 12, block_size: int = 1 << 20, mz_width: float = S.MZ_WIDTH, force_f32: bool = False) -> None:
        if level > 22:
            raise S.Unsupported("compression level above 22")
        self.out, self.force_f32 = out, force_f32
        self.header = R.Header(codec=R.ZSTD if level else R.NONE, level=level, filter=R.SHUFFLE if level else R.RAW, block_size=block_size, mz_width=max(1, round(mz_width)))
        self.bucket = 1 if level <= 5 else 9 if level <= 10 else 12 if level <= 16 else 22
        self.out.write(b"\0" * R.HEADER_BYTES)
        self.at, self.last_rt, self.sealed = R.HEADER_BYTES, -math.inf, False
        self._begin("spectra")
        self.items = {"spectra": [], "chromatograms": []}
        self.slices = {"spectra": [], "chromatograms": []}
        self.addresses = {"spectra": [], "chromatograms": []}
        self.entries = {"spectra": defaultdict(list), "chromatograms": defaultdict(list)}
        self.kinds = {"spectra": set(), "chromatograms": set()}
        self.meta = {"spectra": [], "chromatograms": []}
        self.head: dict[str, dict] = {}

    # blocks

    def _begin(self, name: str) -> None:
        self.name, self.open, self.directory, self.start, self.used, self.pending = name, {}, [], self.at, 0, 0

    def _pack(self, raw: bytes) -> bytes:
        if self.header.codec == R.NONE:
            return raw
        import zstandard

        return zstandard.ZstdCompressor(level=self.bucket).compress(raw)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def _align(self) -> None:
        self._put(b"\0" * (-self.at % 8))

    def _flush(self, key: tuple) -> None:
        number, data = self.open.pop(key)
        raw = b"".join(data)
        self.pending -= len(raw)
        stored = self._pack(A.transpose_bytes(raw, key[1]) if self.header.filter == R.SHUFFLE and key[1] > 1 else raw)
        self.directory[number] = (self.used, len(stored), len(raw), zlib.crc32(stored), 0)
        self._put(stored)
        self.used += len(stored)

    def _store(self, accession: int, dtype: int, window: int, values: np.ndarray, go_on: bool) -> int:
        """Adds a segment; returns its row in the address table."""
        stride = S.DTYPE_BYTES[dtype]
        raw = np.ascontiguousarray(values).tobytes()
        packing = R.DELTA if self.header.codec and dtype <= 2 and accession in DELTA_AXES else R.RAW
        if packing == R.DELTA:
            raw = A.delta_bits(raw, stride)
        key = (accession, stride, window)
        if key in self.open and sum(map(len, self.open[key][1])) + len(raw) > self.header.block_size:  # full
            self._flush(key)
        if key not in self.open:
            self.open[key] = (len(self.directory), [])
            self.directory.append(None)
        number, data = self.open[key]
        offset = sum(map(len, data)) // stride
        data.append(raw)
        self.pending += len(raw)
        if self.pending > PENDING:  # blocks of many windows, none of them full
            for other in list(self.open):
                self._flush(other)
        rows = self.addresses[self.name]
        rows.append((offset, len(values), number, accession, dtype, packing, 0, int(go_on), 0))
        self.kinds[self.name].add(accession)
        return len(rows) - 1

    def _end(self) -> None:
        for key in list(self.open):
            self._flush(key)
        table = np.array(self.directory, R.DIRECTORY).tobytes() if self.directory else b""
        self._put(table)
        self.header.sections[self.name] = (self.start, self.at - self.start)
        self.header.checksums[self.name] = zlib.crc32(table) if table else 0
        self.header.counts["spectrum_blocks" if self.name == "spectra" else "chromatogram_blocks"] = len(self.directory)
        self._align()

    # items

    def spectrum(self, item: dict) -> None:
        if self.sealed:
            raise S.Malformed("a spectrum after a chromatogram")
        rt = item.get("rt", math.nan)
        if math.isfinite(rt):
            if rt < self.last_rt:
                raise S.Malformed("rt falls")
            self.last_rt = rt
        self._item(item)

    def chromatogram(self, item: dict) -> None:
        self._seal()
        self._item(item)

    def _seal(self) -> None:
        if not self.sealed:
            self._end()
            self._begin("chromatograms")
            self.sealed = True

    def _item(self, item: dict) -> None:
        arrays = []
        for a in item.get("arrays") or ():
            dtype = a.get("dtype") or 1
            if self.force_f32 and dtype == 1 and a["accession"] in (S.MZ, S.TIME, S.INTENSITY):
                dtype = 2
            arrays.append((a["accession"], dtype, np.asarray(a["values"]).astype(A.NUMPY[dtype])))
        spectrum = self.name == "spectra"
        mz = next((v for k, _, v in arrays if k == S.MZ), None)
        if spectrum and mz is not None and (mz[1:] < mz[:-1]).any():
            raise S.Malformed("m/z falls")
        first, number = len(self.addresses[self.name]), len(self.items[self.name])
        split = spectrum and mz is not None and len(mz) and all(len(v) == len(mz) and k <= 2 for _, k, v in arrays)
        if split:
            window = np.where(mz > 0, np.floor(mz.astype(np.float64) / self.header.mz_width), 0).astype(np.int64)
            if window.max() > S.MAX_WINDOW:
                raise S.Malformed("m/z value too large for window width")
            cuts = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
            ends = np.append(cuts[1:], len(mz))
        rows: dict[int, dict[int, int]] = defaultdict(dict)
        for k, dtype, v in arrays:
            if split:
                for i, (a, b) in enumerate(zip(cuts.tolist(), ends.tolist())):
                    rows[int(window[a])].setdefault(k, self._store(k, dtype, int(window[a]), v[a:b], i > 0))
            else:
                rows[0].setdefault(k, self._store(k, dtype, 0, v, False))
        x = S.MZ if spectrum else S.TIME
        for w, by in rows.items():
            if x in by and S.INTENSITY in by:
                self.entries[self.name][w].append((number, by[x], by[S.INTENSITY]))
        self.slices[self.name].append((first, len(self.addresses[self.name]) - first))
        dtype = R.A1 if spectrum else R.B1
        whole = {"ms_level", "polarity", "rt_unit", "position_x", "position_y", "position_z"}
        self.items[self.name].append(tuple(item.get(n, 0 if n in whole else math.nan) for n in dtype.names))
        self.meta[self.name].append(_value("spectrum" if spectrum else "chromatogram", item, number))

    # sections

    def _section(self, name: str, raw: bytes, packed: bool = True) -> None:
        stored = self._pack(raw) if packed and raw else raw
        self.header.sections[name] = (self.at, len(stored))
        self.header.checksums[name] = zlib.crc32(stored) if stored else 0
        self._put(stored)
        self._align()

    def _metadata(self, name: str, kind: str) -> None:
        tag, listed = ("spectrum", TAG_SPECTRUM_LIST) if kind == "spectra" else ("chromatogram", TAG_CHROMATOGRAM_LIST)
        items, groups, stored = self.meta[kind], [], []
        used = plain = 0
        total = [0, 0, 0]
        for lo in range(0, len(items), S.GROUP_ITEMS):
            body, counts = metadata_group([E.rows(tag, x) for x in items[lo : lo + S.GROUP_ITEMS]], listed)
            total = [a + b for a, b in zip(total, counts)]
            raw = self._pack(body)
            groups.append((used, len(raw), len(body), zlib.crc32(raw), 0))
            stored.append(raw)
            used, plain = used + len(raw), plain + len(body)
        table = np.array(groups, R.DIRECTORY).tobytes() if groups else b""
        self._section(name, b"".join(stored) + table, packed=False)
        c = self.header.counts
        c[f"{name}_rows"], c[f"{name}_numbers"], c[f"{name}_texts"] = total
        c[f"{name}_plain"], c[f"{name}_groups"] = plain, len(groups)

    def _windows(self, name: str, kind: str) -> None:
        entries = self.entries[kind]
        if not entries:
            self._section(name, b"")
            return
        n = max(entries) + 1
        lists = [sorted(entries.get(w, ())) for w in range(n)]
        flat = np.array([e for x in lists for e in x], "<u4").reshape(-1, 3)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype("<u4")
        raw = np.concatenate([np.array([n, len(flat)], "<u4"), starts, flat.T.ravel()]).astype("<u4").tobytes()
        self.header.counts[f"{name}_plain"] = len(raw)
        self._section(name, raw)

    def _head_items(self) -> tuple[list[list[E.Row]], list[int]]:
        """Rows of the run's own items, and how many there are of each kind."""
        each, sizes, first = [], [], 1
        for tag in R.GLOBAL:
            holder = self.head.get(R.HOLDERS[tag], {})
            values = [holder] if R.HOLDERS[tag] == tag and holder else holder.get(tag, ())
            for value in values:
                each.append(E.rows(tag, value, 0, first))
                first = max(r[0] for r in each[-1]) + 1
            sizes.append(len(values))
        return each, sizes

    def finish(self) -> None:
        """Writes tables, metadata, window directories and the trailer, and the header last; without it the file is invalid."""
        self._seal()
        self._end()
        c = self.header.counts
        c["n_spectra"], c["n_chromatograms"] = len(self.items["spectra"]), len(self.items["chromatograms"])
        c["spectrum_kinds"], c["chromatogram_kinds"] = (len(self.kinds[k] - {0}) for k in ("spectra", "chromatograms"))
        c["group_items"] = S.GROUP_ITEMS
        for prefix, kind, summary in (("A", "spectra", R.A1), ("B", "chromatograms", R.B1)):
            for i, (rows, dtype) in enumerate(((self.items[kind], summary), (self.slices[kind], R.SLICE), (self.addresses[kind], R.ADDRESS)), 1):
                table = np.zeros(len(rows), dtype)
                for j, row in enumerate(rows):
                    table[j] = row
                self._section(f"{prefix}{i}", table.tobytes())
        self._metadata("C", "spectra")
        self._metadata("D", "chromatograms")
        each, sizes = self._head_items()
        columns, (c["E_rows"], c["E_numbers"], c["E_texts"]) = metadata_group(each)
        body = np.array(sizes, "<u2").tobytes().ljust(32, b"\0") + columns[12:]
        c["E_plain"] = len(body)
        self._section("E", body)
        self._windows("A0", "spectra")
        self._windows("B0", "chromatograms")
        self._put(R.TRAILER)
        c["file_size"] = self.at
        self.out.seek(0)
        self.out.write(self.header.pack())


def _value(tag: str, item: dict, number: int) -> dict:
    """The nested value of an item: its element, or its id and parameters."""
    value = E.loaded(tag, item.get("element"))
    if not value:
        pairs = (("cv_ref", "cvRef"), ("accession", "accession"), ("name", "name"), ("value", "value"), ("unit_cv_ref", "unitCvRef"), ("unit_accession", "unitAccession"), ("unit_name", "unitName"))
        value = {"cvParam": [{"_" + b: p.get(a) for a, b in pairs if p.get(a) is not None} for p in item.get("params") or ()]}
    return {"_index": str(number), "_id": item.get("id") or value.get("_id") or ""} | {k: v for k, v in value.items() if k not in ("_index", "_id")}


def metadata_group(items: list[list[E.Row]], listed: int | None = None) -> tuple[bytes, list[int]]:
    """The columns of a group of items' rows; with the tag of a list the first item also has the list's own node, 1."""
    index, rows, numbers, texts = [0], [], [], []

    def kind(text: str | None, attribute: bool) -> int:
        if text is None or text == "":
            return S.VALUE_EMPTY
        if not attribute and is_number(text):
            numbers.append(float(text))
            return S.VALUE_NUMBER
        texts.append(text.encode())
        return S.VALUE_TEXT

    for i, own in enumerate(items):
        if not i and listed is not None:
            own = [(1, 0, listed, S.CV_CODES["ATTR"], ATTR_COUNT, S.CV_UNKNOWN, 0, str(len(items))), *own]
        rows += [(*r[:7], kind(r[7], r[3] == S.CV_CODES["ATTR"])) for r in own]
        index.append(len(rows))
    cols = list(zip(*rows)) if rows else [[]] * 8
    kinds = ("<u4", "<u4", "u1", "u1", "<u4", "u1", "<u4", "u1")
    counts = [len(rows), len(numbers), len(texts)]
    parts = [np.array(counts, "<u4"), np.array(index, "<u4"), *(np.array(c, k) for c, k in zip(cols, kinds)), np.array(numbers, "<f8"), np.array([len(t) for t in texts], "<u4")]
    return b"".join(p.tobytes() for p in parts) + b"".join(texts), counts


def is_number(text: str) -> bool:
    """Whether a text with a point or exponent is the shortest plain decimal of a double; whole numbers stay text."""
    if not any(c in text for c in ".eE"):
        return False
    try:
        x = float(text)
    except ValueError:
        return False
    if not math.isfinite(x):
        return False
    plain = np.format_float_positional(x, trim="-")
    return plain == text


def write(path: str, spectra: Iterable[dict], chromatograms: Iterable[dict] = (), head: dict[str, dict] | None = None, **options) -> None:
    """A whole run to a file; an unfinished file never gets the name."""
    import itertools

    write_rows(path, itertools.chain(({"kind": 1} | s for s in spectra), ({"kind": 2} | c for c in chromatograms)), head, **options)


def write_rows(path: str, rows: Iterable[dict], head: dict[str, dict] | None = None, **options) -> int:
    """Sorted rows of one run (kind 0: tag and element of its head, 1: spectra, 2: chromatograms) to a file; how many."""
    import os

    sweep(path)
    n, temporary = 0, f"{path}.{os.getpid()}.tmp"
    try:
        with open(temporary, "wb") as f:
            w = Writer(f, **options)
            w.head.update(head or {})
            for n, row in enumerate(rows, 1):  # noqa: B007
                add(w, row)
            w.finish()
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)
    return n


def sweep(path: str) -> list[str]:
    """Removes unfinished files of a path whose process is gone; their names."""
    import glob
    import os

    gone = []
    for name in glob.glob(glob.escape(path) + ".*.tmp"):
        pid = name.split(".")[-2]
        if pid.isdigit() and not os.path.exists(f"/proc/{pid}"):
            os.remove(name)
            gone.append(name)
    return gone


def add(w: Writer, row: dict) -> None:
    kind, item = row.get("kind", 1), {k: v for k, v in row.items() if v is not None}
    if kind == 0:
        tag = E.ELEMENTS_NOW.get(item["tag"], item["tag"])
        w.head.setdefault(tag, E.loaded(tag, item.get("element")))
    elif kind == 1:
        w.spectrum(item)
    else:
        w.chromatogram(item)


def rows(spectra, chromatograms=None, heads=None, by: str = "source_path"):
    """Rows that become files, a partition for each run and in its order: (by, kind, at, tag, element, id, params, arrays,
    summary columns). heads: as `sources.mzml.heads` gives them."""
    from pyspark.sql import functions as F

    names = dict.fromkeys((*R.A1.names, *R.B1.names, "id", "element", "params", "arrays"))

    def one(df, kind: int, at):
        return df.select(F.col(by), F.lit(kind).alias("kind"), at.cast("long").alias("at"), *(F.col(c) for c in ("tag", *names) if c in df.columns))

    out = one(spectra, 1, F.col("spectrum_index"))
    if chromatograms is not None:
        slim = lambda df: df.withColumn("arrays", F.transform("arrays", lambda a: F.struct(a["accession"], a["dtype"], a["values"])))
        out = one(slim(spectra), 1, F.col("spectrum_index")).unionByName(one(slim(chromatograms), 2, F.col("chromatogram_index")), allowMissingColumns=True)
    if heads is not None:
        out = out.unionByName(one(heads, 0, F.lit(0)), allowMissingColumns=True)
    return out.repartition(by).sortWithinPartitions(by, "kind", "at")


def files(spectra, by: str = "source_path", chromatograms=None, heads=None, **options):
    """(run, content) of runs: one task for each run, whose rows come sorted and go one by one into its buffer."""
    import io

    import pyarrow as pa

    def run(batches):
        def each():
            for batch in batches:
                for r in range(0, batch.num_rows, 64):
                    yield from batch.slice(r, 64).to_pylist()

        name, w, buffer = None, None, None

        def done():
            w.finish()
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([buffer.getvalue()], pa.binary())], names=["run", "content"])

        for row in each():
            if w is None or str(row[by]) != name:
                if w is not None:
                    yield done()
                name, buffer = str(row[by]), io.BytesIO()
                w = Writer(buffer, **options)
            add(w, row)
        if w is not None:
            yield done()

    return rows(spectra, chromatograms, heads, by).mapInArrow(run, "run string, content binary")


def set_version(path: str, version: int = 1) -> bool:
    """Writes another version into a file's header; False if it has it already. Only supported versions are accepted."""
    with open(path, "r+b") as f:
        header = R.Header.parse(f.read(R.HEADER_BYTES))
        if header.version == version:
            return False
        if not 0 <= version <= 1:
            raise S.Unsupported(f"format version {version}")
        header.version = version
        f.seek(0)
        f.write(header.pack())
    return True
