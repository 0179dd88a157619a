"""Runs that programs make: items one by one, from memory or any producer, into files or DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..functions import arrays as A


class Producer(Protocol):
    """What gives a run: values of its head by tag, then its spectra, then its chromatograms, each read once and in order."""

    def head(self) -> dict[str, dict]: ...

    def spectra(self) -> Iterator[dict]: ...

    def chromatograms(self) -> Iterator[dict]: ...


def array(accession: int, values, dtype: int = 1) -> dict:
    """An array of an item, in its element type."""
    return {"accession": accession, "dtype": dtype, "values": np.asarray(values).astype(A.NUMPY[dtype])}


def spectrum(id: str, mz, intensity, **summary) -> dict:
    """A spectrum of two double-precision arrays; summary: values such as rt and ms_level."""
    return {"id": id, "arrays": [array(S.MZ, mz), array(S.INTENSITY, intensity)], **summary}


def chromatogram(id: str, time, intensity, **summary) -> dict:
    return {"id": id, "arrays": [array(S.TIME, time), array(S.INTENSITY, intensity)], **summary}


@dataclass
class Memory:
    """A producer of what it holds."""

    scans: list[dict] = field(default_factory=list)
    traces: list[dict] = field(default_factory=list)
    about: dict[str, dict] = field(default_factory=dict)

    def head(self) -> dict[str, dict]:
        return self.about

    def spectra(self) -> Iterator[dict]:
        return iter(self.scans)

    def chromatograms(self) -> Iterator[dict]:
        return iter(self.traces)


def write(producer: Producer, path: str, **options) -> None:
    """A producer's run to a run file; one item is held at a time."""
    from ..sinks import runfile

    runfile.write(path, producer.spectra(), producer.chromatograms(), producer.head(), **options)


def _rows(items: Iterable[dict], index: str, run_id: str) -> Iterator[tuple]:
    for i, x in enumerate(items):
        arrays = [(a["accession"], a.get("dtype") or 1, np.asarray(a["values"]).astype(float).tolist()) for a in x.get("arrays") or ()]
        yield run_id, i, x.get("id") or f"index={i}", arrays, x.get("rt"), x.get("ms_level")


def frames(spark: SparkSession, producer: Producer, run_id: str = "memory") -> tuple[DataFrame, DataFrame]:
    """Spectra and chromatograms as the sources give them: source_path, index, id, arrays, rt, ms_level.

    Items go through the driver, as they come from it; for more than it can hold, write a file and read that.
    """
    kind = "arrays array<struct<accession:bigint,dtype:smallint,values:array<double>>>, rt double, ms_level short"
    make = lambda items, index: spark.createDataFrame(list(_rows(items, index, run_id)), f"source_path string, {index} long, id string, {kind}")
    return make(producer.spectra(), "spectrum_index"), make(producer.chromatograms(), "chromatogram_index")
