"""Batch report job: ingest -> features -> chosen analyses -> Parquet/CSV.

Usage with spark-submit::

    spark-submit scripts/run_report.py --input logs/ --pattern '*.log.gz' \\
        --out /shared/reports/run1 --analyses summary,top_ips,anomalies,brute_force

Every result is written by the executors (no ``collect``). The featured table
is written once as Parquet, clustered by date: to ``save_parquet`` if that is
given, else to a folder under ``spark.checkpoint.dir`` that is removed at the
end. The analyses read pruned columns from it, and a lost executor only means
rereading files. An enabled analysis without rows still writes its (empty)
folder.

A result is written beside its place, moved there, and then entered in the
manifest ``<out>_manifest`` with a key: the fingerprint of the input files,
how they were read, and the parameters that the result depends on. With
``resume`` a later run keeps every result whose key is the same, and the stage
table of a run that was stopped, and does the rest.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clients, detectors, errors, isolation_forest, summary
from ..session import ensure_checkpoint_dir
from ..sinks.writers import folder_exists, move_folder, remove_folder, result_path, write_csv, write_parquet
from ..sources.load import format_of, load_access_log, read_parquet_log
from ..sources.raw_log import ParseMetrics

ANALYSES = ("summary", "top_ips", "top_404", "anomalies", "brute_force", "iqr", "isolation_forest",
            "full_table", "quality")
DEFAULTS = {"top_ips": 20, "top_404": 10, "z_score": 3.0, "window_minutes": 5, "threshold": 20,
            "contamination": 0.05}
#: The parameters that change a result, by its suffix.
DEPENDS = {"_top_ips": ("top_ips",), "_top_404": ("top_404",), "_anomalies": ("z_score",),
           "_bruteforce": ("window_minutes", "threshold"), "_anomaly_report": ("contamination",)}
QUALITY = "total_lines long, parsed_lines long, failed_lines long, blank_lines long, bad_timestamps long, parse_pct double"
MANIFEST = "suffix string, key string, path string"


def build_results(df: DataFrame, analyses: tuple[str, ...], params: dict) -> dict[str, DataFrame]:
    """Lazy result DataFrames keyed by the output suffix."""
    return {suffix: make(df) for suffix, make in planned_results(analyses, params).items()}


def planned_results(analyses: tuple[str, ...], params: dict) -> dict:
    """What makes each result from the featured table, by the output suffix."""
    p = {**DEFAULTS, **params}
    out = {}
    if "summary" in analyses or not analyses:
        out["_summary"] = summary.summary_report
    if "top_ips" in analyses and p["top_ips"] > 0:
        out["_top_ips"] = lambda df: clients.top_ips(df, n=p["top_ips"])
    if "top_404" in analyses and p["top_404"] > 0:
        out["_top_404"] = lambda df: errors.top_404_paths(df, n=p["top_404"])
    if "anomalies" in analyses:
        out["_anomalies"] = lambda df: detectors.traffic_anomalies(df, z_threshold=p["z_score"])
    if "brute_force" in analyses:
        out["_bruteforce"] = lambda df: detectors.brute_force(df, window_minutes=p["window_minutes"], threshold=p["threshold"])
    if "iqr" in analyses:
        out["_iqr_outliers"] = detectors.iqr_outliers
    if "isolation_forest" in analyses:
        out["_anomaly_report"] = lambda df: isolation_forest.isolation_forest(df, contamination=p["contamination"])
    if "full_table" in analyses:
        out["_parsed"] = lambda df: df
    return out


def input_fingerprint(spark: SparkSession, path: str, pattern: str | None) -> str:
    """Digest of the names, lengths and times of the input files, taken on the
    executors; their order does not matter."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        folder, _, name = pattern.rpartition("/")
        path, reader = f"{path.rstrip('/')}/{folder}", reader.option("pathGlobFilter", name.replace("[!", "[^"))
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    try:
        row = reader.load(path).agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(one), F.sum(one.cast("decimal(38, 0)"))).first()
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"no such log: {path}") from exc
        raise
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()


class Manifest:
    """Finished results of an output prefix: one small JSON file each."""

    def __init__(self, spark: SparkSession, out_prefix: str):
        self.spark, self.folder = spark, result_path(out_prefix, "_manifest")

    def entries(self) -> dict[str, tuple[str, str]]:
        """suffix -> (key, path)."""
        if not folder_exists(self.spark, self.folder):
            return {}
        rows = self.spark.read.schema(MANIFEST).json(f"{self.folder}/*").collect()
        return {r.suffix: (r.key, r.path) for r in rows}

    def enter(self, suffix: str, key: str, path: str) -> None:
        entry = self.spark.createDataFrame([(suffix, key, path)], MANIFEST).coalesce(1)
        entry.write.mode("overwrite").json(f"{self.folder}/entry{suffix}")

    def drop(self, suffix: str) -> None:
        remove_folder(self.spark, f"{self.folder}/entry{suffix}")


def run_report(spark: SparkSession, input_path: str, out_prefix: str,
               analyses: tuple[str, ...] = (), params: dict | None = None,
               pattern: str | None = None, save_parquet: str | None = None,
               fmt: str = "csv", repartition: int | None = None, multi_line: bool | str = True,
               skip_unreadable: bool = True, resume: bool = False) -> dict[str, str]:
    """Run the job; returns {suffix: written path}. With no analyses chosen
    the summary is written. Of a pattern's files those that cannot be read to
    their end are left out and listed in the result ``_skipped_files``, or
    fail the job without ``skip_unreadable``. ``quality`` (raw logs only)
    writes the line counts that the ingest took on its way."""
    unknown = sorted(set(analyses) - set(ANALYSES))
    if unknown:
        raise ValueError(f"unknown analyses {unknown}; there are {', '.join(ANALYSES)}")
    if "quality" in analyses and format_of(input_path, pattern) != "log":
        raise ValueError("the analysis 'quality' counts the lines of raw logs; the input is a table")
    params = {**DEFAULTS, **(params or {})}
    plans = planned_results(tuple(analyses), params)
    read = {"files": input_fingerprint(spark, input_path, pattern), "pattern": pattern, "multi_line": multi_line,
            "skip_unreadable": skip_unreadable}

    def key(suffix: str) -> str:
        depends = {k: params[k] for k in DEPENDS.get(suffix, ())}
        return hashlib.sha256(json.dumps([suffix, read, fmt, depends], sort_keys=True).encode()).hexdigest()

    manifest = Manifest(spark, out_prefix)
    done = manifest.entries() if resume else {}
    if resume and save_parquet and "_stage" in done and done["_stage"][1] != save_parquet:
        del done["_stage"]

    def finished(suffix: str) -> bool:
        return done.get(suffix, ("",))[0] == key(suffix) and folder_exists(spark, done[suffix][1])

    ingest = {"_skipped_files"} | ({"_parse_quality"} if "quality" in analyses else set())
    written = {suffix: done[suffix][1] for suffix in [*plans, *ingest] if finished(suffix)}
    left = {suffix: make for suffix, make in plans.items() if suffix not in written}
    need_ingest = "_parse_quality" in ingest and "_parse_quality" not in written
    keep_stage = save_parquet is not None

    def put(suffix: str, res: DataFrame) -> None:
        path = result_path(out_prefix, suffix)
        beside = f"{path}.unfinished"
        (write_csv if fmt == "csv" else write_parquet)(res, beside)
        manifest.drop(suffix)
        move_folder(spark, beside, path)
        manifest.enter(suffix, key(suffix), path)
        written[suffix] = path

    if not left and not need_ingest and (not keep_stage or finished("_stage")):
        return written
    if finished("_stage") and not need_ingest:
        stage = done["_stage"][1]
    else:
        stage = save_parquet or f"{ensure_checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
        skipped: list[tuple[str, str]] | None = [] if pattern and skip_unreadable else None
        metrics = ParseMetrics(f"report_{uuid.uuid4().hex}") if "quality" in analyses else None
        df = load_access_log(spark, input_path, pattern=pattern, repartition=repartition, multi_line=multi_line,
                             skipped=skipped, metrics=metrics)
        manifest.drop("_stage")
        write_parquet(df, stage, partition_by="date")
        if skipped:
            put("_skipped_files", spark.createDataFrame(skipped, "file string, reason string"))
        if metrics:
            figures = metrics.get()
            put("_parse_quality", spark.createDataFrame([tuple(figures.values())], QUALITY))
        manifest.enter("_stage", key("_stage"), stage)
    try:
        df = read_parquet_log(spark, stage)
        for suffix, make in left.items():
            put(suffix, make(df))
    except BaseException:
        if not resume and not keep_stage:  # a run that may be resumed leaves its stage
            manifest.drop("_stage")
            remove_folder(spark, stage)
        raise
    if not keep_stage:
        manifest.drop("_stage")
        remove_folder(spark, stage)
    return written


def main(argv: list[str] | None = None) -> dict[str, str]:
    ap = argparse.ArgumentParser(description="Access-log report job on Spark")
    ap.add_argument("--input", required=True)
    ap.add_argument("--out", required=True, help="output prefix; one directory per result")
    ap.add_argument("--pattern", default=None, help="glob of files inside --input (batch mode)")
    ap.add_argument("--analyses", default="", help=",".join(ANALYSES))
    ap.add_argument("--save-parquet", default=None)
    ap.add_argument("--format", default="csv", choices=("csv", "parquet"))
    ap.add_argument("--repartition", type=int, default=None,
                    help="spread the parse of a few large gzip logs over N tasks")
    ap.add_argument("--csv-records", default="whole", choices=("whole", "split", "lines"),
                    help="CSV with line breaks in cells: a file a task, or many tasks; lines: there are none")
    ap.add_argument("--fail-unreadable", action="store_true", help="a file that cannot be read fails the job")
    ap.add_argument("--resume", action="store_true", help="keep finished results of an earlier run with the same keys")
    for k, v in DEFAULTS.items():
        ap.add_argument("--" + k.replace("_", "-"), type=type(v), default=v)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("logtide-report").getOrCreate()
    params = {k: getattr(a, k) for k in DEFAULTS}
    chosen = tuple(x for x in a.analyses.split(",") if x)
    multi_line = {"whole": True, "split": "split", "lines": False}[a.csv_records]
    return run_report(spark, a.input, a.out, chosen, params, a.pattern, a.save_parquet, a.format,
                      a.repartition, multi_line, not a.fail_unreadable, a.resume)


if __name__ == "__main__":
    main()
