"""Event logs from Parquet and CSV files.

Logs of several versions may lie side by side. A Spark job reads the footer or header of every file, files of the same columns are read
together with the columns they have, and each file is held against the log's columns. What reaches the driver
are the paths, which Spark's own listing of a folder brings there as well.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauflow.schemas import EVENT, EVENT_KEYS, POLICIES, PROFILES, UNKNOWN

SOURCE_FILE = "__source_file"
# Which files of a directory are taken, first rule that finds any.
RULES = (("events.parquet", "parquet"), ("*.parquet", "parquet"), ("*.csv", "csv"))
# The collector's column names and those of the log schema.
RENAMED = {"ts": "ts_ns", "mqtt_size_bytes": "mqtt_bytes"}


@dataclass(frozen=True)
class Source:
    """One input: a file, or a directory with the file name pattern to take from it."""

    path: str
    kind: str
    pattern: str | None = None


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _contains(fs, directory, pattern: str) -> bool:
    """Whether the tree below ``directory`` has a file of that name; stops at the first one."""
    files = fs.listFiles(directory, True)
    suffix = pattern.lstrip("*")
    while files.hasNext():
        name = files.next().getPath().getName()
        if name == pattern or (pattern.startswith("*") and name.endswith(suffix)):
            return True
    return False


def discover_inputs(spark: SparkSession, paths: Iterable[str]) -> list[Source]:
    """Choose the rule per directory; files pass as given; repeated inputs are taken once."""
    found: dict[str, Source] = {}
    for path in paths:
        fs, hadoop_path = _file_system(spark, path)
        if not fs.exists(hadoop_path):
            continue
        resolved = fs.resolvePath(hadoop_path).toString()
        # A directory of part files that is itself named like a log counts as that log.
        if fs.getFileStatus(hadoop_path).isFile():
            kind = next((k for k in ("parquet", "csv") if resolved.lower().endswith("." + k)), None)
            if kind:
                found.setdefault(resolved, Source(resolved, kind))
            continue
        for pattern, kind in RULES:
            if _contains(fs, hadoop_path, pattern):
                found.setdefault(resolved, Source(resolved, kind, pattern))
                break
    # A file below a directory that is read anyway must not be read twice.
    directories = [s for s in found.values() if s.pattern]
    return [
        s for s in found.values()
        if s.pattern or not any(_covers(d, s) for d in directories)
    ]


def _covers(directory: Source, file: Source) -> bool:
    name = file.path.rsplit("/", 1)[-1]
    fits = name == directory.pattern or (
        directory.pattern.startswith("*") and name.endswith(directory.pattern.lstrip("*"))
    )
    return fits and file.path.startswith(directory.path.rstrip("/") + "/")


def _opened(path: str):
    """A file on any file system that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _layout_of(path: str, kind: str) -> list[str] | None:
    """Columns of a file as ``name type``; None for a CSV file without any content."""
    with _opened(path) as file:
        if kind == "parquet":
            import pyarrow.parquet as pq

            return [f"{f.name} {f.type}" for f in pq.read_schema(file)]
        with io.TextIOWrapper(file, encoding="utf-8-sig", newline="") as text:
            header = next(csv.reader(text), None)
    return None if header is None else [f"{name} string" for name in header]


def _layouts(kind: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    layout = _layout_of(path, kind)
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as error:
                    if "filesystem type" not in str(error):
                        raise
                    rows.append((path, None, False))
                else:
                    rows.append((path, layout, True))
            yield pd.DataFrame(rows, columns=["path", "layout", "opened"])

    return read


_LAYOUT = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("layout", T.ArrayType(T.StringType())), T.StructField("opened", T.BooleanType())])


def file_layouts(spark: SparkSession, source: Source) -> dict[tuple[str, ...], list[str]]:
    """Paths of a source's files by their columns. CSV files without any content have no rows and are left out.

    Spark lists the files (their content is not read), and its tasks open each one at its footer or first line. Files on a file system that
    Arrow does not know are opened by Spark's own reader, one after the other.
    """
    reader = spark.read.format("binaryFile")
    if source.pattern:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", source.pattern)
    files = reader.load(_literal(source.path)).select("path").mapInPandas(_layouts(source.kind), _LAYOUT)
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(files.collect(), key=lambda r: r.path):
        layout = row.layout
        if not row.opened:
            one = spark.read.option("header", source.kind == "csv").format(source.kind).load(_literal(row.path))
            layout = [f"{f.name} {f.dataType.simpleString()}" for f in one.schema] or None
        if layout is not None:
            groups.setdefault(tuple(layout), []).append(row.path)
    return groups


def _literal(path: str) -> str:
    """A path without wildcards: signs that a path pattern gives a meaning stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _read(spark: SparkSession, kind: str, layout: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """Files of one layout; the columns of CSV files are text, typed later."""
    reader = spark.read.option("recursiveFileLookup", True)
    if kind == "csv":
        names = [c.rsplit(" ", 1)[0] for c in layout]
        reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("header", True)
    df = reader.format(kind).load([_literal(p) for p in paths])
    return df.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))


def require_columns(df: DataFrame, required: Sequence[str], where: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{where} missing columns: {missing}")


def infer_run(file_path: Column) -> tuple[Column, Column]:
    """Profile and policy from a parent directory ``<profile>__<mode>``; both unknown if it names no valid pair."""
    directory = F.element_at(F.split(file_path, "/"), -2)
    profile, policy = F.substring_index(directory, "__", 1), F.regexp_extract(directory, "^.*?__(.*)$", 1)
    valid = profile.isin(*PROFILES) & policy.isin(*POLICIES)
    return F.when(valid, profile).otherwise(UNKNOWN), F.when(valid, policy).otherwise(UNKNOWN)


def _with_run(df: DataFrame) -> DataFrame:
    profile, policy = infer_run(F.col(SOURCE_FILE))
    if "profile" not in df.columns and "policy" not in df.columns:
        return df.withColumn("profile", profile).withColumn("policy", policy)
    return df


def cast_events(df: DataFrame) -> DataFrame:
    """The log schema's types for its columns; other columns stay as they are."""
    types = {f.name: f.dataType for f in EVENT}
    types["mqtt_bytes"] = "bigint"
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def read_events(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """All event logs found under ``paths`` as one typed table, each row tagged with its file.

    A file without one of the log's columns stops the reading and is named; profile and policy may both be absent, then the folder's
    name tells them. CSV files may each have an order of columns of their own.
    """
    paths = list(paths)
    sources = discover_inputs(spark, paths)
    if not sources:
        raise FileNotFoundError(f"no parquet or csv input below {paths}")
    parts = []
    for source in sources:
        for layout, files in file_layouts(spark, source).items():
            df = _with_run(_read(spark, source.kind, layout, files))
            for old, new in RENAMED.items():
                if old in df.columns and new not in df.columns:
                    df = df.withColumnRenamed(old, new)
            require_columns(df, ["ts_ns" if k == "ts" else k for k in EVENT_KEYS], files[0])
            parts.append(cast_events(df))
    if not parts:
        raise FileNotFoundError(f"no parquet or csv file with content below {paths}")
    return union_sources(parts)


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
