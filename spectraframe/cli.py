"""Command line: convert, cat, check and update."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spectraframe")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="files to native datasets, or a native dataset back; all files below a folder")
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--kind", default="auto", choices=["auto", "to_parquet", "to_mzml", "to_runfile"])
    c.add_argument("--mz-window", type=float, default=20.0)
    c.add_argument("--level", type=int, default=12)
    c.add_argument("--force-f32", action="store_true")
    c.add_argument("--overwrite", action="store_true")
    names = c.add_mutually_exclusive_group()
    names.add_argument("--pattern", help="parts of file names: | or, & and")
    names.add_argument("--pattern-exact")
    names.add_argument("--regex")
    c.add_argument("--zlib", action="store_true")
    a = sub.add_parser("cat", help="JSON of spectra or chromatograms, or of the head")
    a.add_argument("input")
    which = a.add_mutually_exclusive_group()
    which.add_argument("--scan", type=int, help="number of a spectrum, from 1")
    which.add_argument("--chrom", type=int, help="number of a chromatogram, from 1")
    which.add_argument("--head", action="store_true")
    a.add_argument("--full", action="store_true")
    k = sub.add_parser("check", help="checks of a native dataset or a run file")
    k.add_argument("input")
    u = sub.add_parser("update", help="writes the current format version into run files")
    u.add_argument("input", nargs="+")
    u.add_argument("--format-version", type=int, default=1)
    return p


def _convert(spark, args) -> int:
    from . import files

    options = {"width": args.mz_window, "compress": args.zlib, "level": args.level, "force_f32": args.force_f32}
    chosen = [args.pattern, args.pattern_exact, args.regex]
    many = files.kind_of(args.input) == "dataset" and (args.kind == "to_parquet" or any(x is not None for x in chosen))
    if not many:
        if any(x is not None for x in chosen):
            print("names are chosen among the files below a folder", file=sys.stderr)
            return 2
        print(files.convert(spark, args.input, args.output, args.kind, **options))
        return 0
    results = files.convert_all(spark, args.input, args.output, "to_parquet", *chosen, overwrite=args.overwrite, **options)
    for r in results:
        print(r["status"], r["path"], r["message"])
    if results:
        for r in files.counters(spark.createDataFrame(results, "path string, status string, message string")).collect():
            print(f"{r.status}: {r.n}")
    return int(any(r["status"] == "failed" for r in results))


def _cat(spark, args) -> int:
    from pyspark.sql import functions as F

    from . import files
    from .sinks import parquet
    from .sources import mzml, runfile

    chrom, run = args.chrom is not None, files.kind_of(args.input) == "run"
    index, n = ("chromatogram_index", args.chrom) if chrom else ("spectrum_index", args.scan)
    if args.head:
        table = runfile.read_files(spark, args.input, "head") if run else mzml.heads(spark, args.input)
        for r in table.orderBy("source_path", "tag").toLocalIterator():
            print(f'{{"{r.tag}": {r.element}}}')
        return 0
    if run:
        names = ("chromatogram_arrays", "chromatogram_elements") if chrom else ("arrays", "elements")
        table, more = (runfile.read_files(spark, args.input, x) for x in names)
        table = table.join(more, ["source_path", index], "left").withColumn("id", F.get_json_object("element", "$._id"))
    else:
        table = mzml.chromatograms(spark, args.input) if chrom else mzml.spectra(spark, args.input)
    if n is not None:
        table = table.where(F.col(index) == n - 1)
        if n < 1 or table.isEmpty():
            print(f"{n} is out of range", file=sys.stderr)
            return 1
    for r in parquet.to_json((table if args.full else table.drop("arrays")).orderBy(index)).toLocalIterator():
        print(r.value)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "update":
        from .sinks import runfile as sink

        for path in args.input:
            print(path, "changed" if sink.set_version(path, args.format_version) else "as it was")
        return 0
    spark = SparkSession.builder.appName("spectraframe").getOrCreate()
    if args.command == "convert":
        return _convert(spark, args)
    if args.command == "cat":
        return _cat(spark, args)
    if args.input.endswith(".run"):
        from .sources import runfile

        results = runfile.check(args.input)
        for n, label, ok in results:
            print(f"{n} {label}: {'ok' if ok else 'failed'}")
        return int(not all(ok for _, _, ok in results))
    from .operators import validate
    from .sinks import parquet

    spectra, peaks, _ = parquet.read_run(spark, args.input)
    rows = validate.check_run(spectra, peaks).orderBy("check_no").collect()
    for r in rows:
        print(f"{r.check_no + 1} {r.label}: {'ok' if r.passed else f'{r.violations} violations'}")
    return int(not all(r.passed for r in rows))


if __name__ == "__main__":
    sys.exit(main())
