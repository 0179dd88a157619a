"""Files: discovery, name filters, what is done already, counters, and conversion."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import scalar as fn


def discover(spark: SparkSession, path: str, extension: str = "mzml", pattern: str | None = None, exact: str | None = None, regex: str | None = None) -> DataFrame:
    """(path, name, length) of files below path with an extension in any case, by path; names filtered."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.lower("name").endswith("." + extension.lower()))
    return files.where(fn.name_filter(F.col("name"), pattern, exact, regex)).orderBy("path")


def not_done(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """inputs(stem, n_spectra, n_chromatograms) without an output of the same counts."""
    return inputs.join(outputs, ["stem", "n_spectra", "n_chromatograms"], "left_anti")


def counters(results: DataFrame) -> DataFrame:
    """Counts of the statuses of results(status): ok, failed, skipped, fixed."""
    statuses = results.sparkSession.createDataFrame([("ok",), ("failed",), ("skipped",), ("fixed",)], "status string")
    return statuses.join(results.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def kind_of(path: str, spark: SparkSession | None = None) -> str:
    """What a path holds, by its extension in any case: mzml, run, or dataset; with a session by its first bytes as well."""
    lower = path.lower().rstrip("/")
    kind = "mzml" if lower.endswith(".mzml") else "run" if lower.endswith(".run") else "dataset"
    if kind == "dataset" and spark is not None:
        from .sources import mzml, runfile

        head = mzml.first_bytes(spark, path, 8)
        kind = "mzml" if head.lstrip(b"\xef\xbb\xbf \r\n\t").startswith(b"<") else "run" if head == runfile.SIGNATURE else kind
    return kind


def convert(spark: SparkSession, source: str, target: str, kind: str = "auto", width: float = S.MZ_WIDTH, compress: bool = False, level: int = 12, force_f32: bool = False) -> str:
    """mzML or run files to a native dataset, or a native dataset of arrays to mzML or run files.

    kind: to_parquet, to_mzml, to_runfile or auto, which goes by the source's extension. All that a document holds
    goes along: its head and run, elements as they are, chromatograms, arrays in their types.
    """
    from .sinks import mzml as out
    from .sinks import parquet
    from .sinks import runfile as run_out
    from .sources import mzml, runfile

    fn.positive(width, "mz_width")
    store = lambda df, name: df.write.option("compression", "zstd").parquet(f"{target}/{name}")
    if kind == "auto":
        kind = "to_parquet" if kind_of(source, spark) != "dataset" else "to_mzml"
    if kind == "to_parquet" and kind_of(source, spark) == "run":
        contents = spark.read.format("binaryFile").load(source).select("path", "content")
        table = lambda name: runfile.read_contents(contents, name)
        named = lambda df, index: df.withColumn("id", F.coalesce(F.nullif(F.get_json_object("element", "$._id"), F.lit("")), F.concat(F.lit("index="), F.col(index))))
        spectra, arrays = table("spectra"), table("arrays")
        keys = ["source_path", "spectrum_index"]
        store(named(arrays.join(spectra, keys).join(table("elements"), keys, "left"), "spectrum_index"), "arrays")
        keys = ["source_path", "chromatogram_index"]
        store(named(table("chromatogram_arrays").join(table("chromatograms"), keys).join(table("chromatogram_elements"), keys, "left"), "chromatogram_index"), "chromatograms")
        store(table("head"), "head")
        parquet.write_run(target, spectra.withColumnRenamed("source_path", "run_id"), mzml.peaks(arrays, width), width)
    elif kind == "to_parquet":
        short = mzml.truncated(spark, source).first()
        if short:
            raise S.Malformed(f"{short.source_path} breaks off")
        spectra = mzml.spectra(spark, source)
        store(spectra, "arrays")
        store(mzml.chromatograms(spark, source), "chromatograms")
        store(mzml.heads(spark, source), "head")
        stored = spark.read.parquet(f"{target}/arrays")
        parquet.write_run(target, stored.drop("arrays", "element").withColumnRenamed("source_path", "run_id"), mzml.peaks(stored, width), width)
    elif kind in ("to_runfile", "to_mzml"):
        spectra, chromatograms, heads = (spark.read.parquet(f"{source}/{x}") for x in ("arrays", "chromatograms", "head"))
        if kind == "to_runfile":
            spark.dataSource.register(runfile.RunFileSource)
            # A run to a task: a file is written from front to back.
            run_out.rows(spectra, chromatograms, heads).write.format("runfile").option("mzWindow", width).option("level", level).option("forceF32", str(force_f32).lower()).mode("append").save(target)
        else:
            docs = out.documents(spectra, chromatograms, compress=compress, heads=heads)
            # A folder for each run; the writer adds the last newline.
            docs.select(F.regexp_replace("document", "\n$", "").alias("document"), "run").write.partitionBy("run").text(target)
    else:
        raise S.Unsupported(f"kind {kind}")
    return kind


def convert_all(spark: SparkSession, source: str, target: str, kind: str = "to_parquet", pattern: str | None = None, exact: str | None = None, regex: str | None = None, overwrite: bool = False, **options) -> list[dict]:
    """Each mzML and run file below a folder to a place of its own below target: (path, status, message) of each.

    Names are filtered as `discover` does. A file whose dataset has as many spectra and chromatograms as the file is
    skipped unless overwritten; a file that fails does not stop the others. One driver loop over files, each of which
    is a distributed conversion.
    """
    from .sources import mzml, runfile

    found = discover(spark, source, "mzml", pattern, exact, regex).union(discover(spark, source, "run", pattern, exact, regex))
    out = []
    for row in found.orderBy("path").collect():
        place = f"{target.rstrip('/')}/{stem(row.path)}"
        try:
            if kind_of(row.path) == "mzml":
                tails = mzml.run_heads(spark, row.path).where("tag <> 'mzML' and tag <> 'run'").collect()
                counts = {t.tag: n for t in tails if (n := _count(t.element)) is not None}
                n = (counts.get("spectrumList", 0), counts.get("chromatogramList", 0))
            else:
                n = tuple(runfile.read_files(spark, row.path, t).count() for t in ("spectra", "chromatograms"))
            if not overwrite and kind == "to_parquet" and _counts_of(spark, place) == n:
                out.append({"path": row.path, "status": "skipped", "message": ""})
                continue
            clear(spark, place)
            convert(spark, row.path, place, kind, **options)
            out.append({"path": row.path, "status": "ok", "message": ""})
        except Exception as e:  # noqa: BLE001  the others go on; the status says what became of this one
            out.append({"path": row.path, "status": "failed", "message": str(e).splitlines()[0][:300]})
    return out


def _count(element: str) -> int | None:
    import json

    said = json.loads(element).get("_count")
    return int(said) if said and said.isdigit() else None


def _counts_of(spark: SparkSession, dataset: str) -> tuple[int, int] | None:
    """Spectra and chromatograms of a native dataset; None if it is not whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{dataset}/arrays/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    try:
        return tuple(spark.read.parquet(f"{dataset}/{x}").count() for x in ("arrays", "chromatograms"))
    except Exception:  # noqa: BLE001  a part is missing
        return None


def clear(spark: SparkSession, path: str) -> None:
    """Removes what an unfinished conversion left at a place."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]
