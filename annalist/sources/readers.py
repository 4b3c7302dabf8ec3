"""Readers of entity documents, labels, claims, truth tables and chains."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

#: Lines in an outgoing batch of the zstd reader.
LINES = 5000


def list_shards(folder: str, year: int) -> list[str]:
    """Shards ``entities-<year>-part-*.jsonl.zst`` of a year in order; FileNotFoundError if there is none."""
    found = [f"{folder.rstrip('/')}/{n}" for n in storage.names(folder) if n.startswith(f"entities-{year}-part-") and n.endswith(".jsonl.zst")]
    if not found:
        raise FileNotFoundError(f"no shards of {year} in {folder}")
    return found


def find_raw_dump(folder: str) -> str:
    """The newest (last by path) .bz2 or .gz file below a folder; FileNotFoundError if there is none."""
    found = [p for p in storage.files_below(folder) if p.endswith((".bz2", ".gz"))]
    if not found:
        raise FileNotFoundError(f"no dump below {folder}")
    return found[-1]


def read_zst_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path`` and ``line`` of zstd-compressed text files (paths or patterns): one task a file, which streams it from storage; blank lines drop out.

    No file is ever held whole. The task opens a path by Arrow's file systems, so its scheme must be one of theirs.
    """
    found = [p for given in (paths if isinstance(paths, list) else [paths]) for p in storage.matching(given)]
    if not found:
        raise FileNotFoundError(f"no file at {paths}")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("line", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                with files.open_input_stream(at, compression=None) as stream:
                    reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True), encoding="utf-8")
                    while lines := [x for line in islice(reader, LINES) if (x := line.strip()) or line]:
                        kept = [x for x in lines if x]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(kept), pa.string()), pa.array(kept, pa.string())], names=schema.names)

    files = spark.createDataFrame([(p,) for p in found], "path string")
    return files.repartitionByRange(len(found), "path").mapInArrow(run, schema)


def read_raw_dump(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of a raw dump (.bz2, .gz or plain): an array with one document a line; brackets, blanks and the comma at the end go."""
    text = F.regexp_replace(F.trim("value"), r"\s*,$", "")
    return spark.read.text(path).select(text.alias("line")).filter(~F.col("line").isin("", "[", "]"))


def read_entities(spark: SparkSession, folder: str, year: int, source: str = "auto") -> DataFrame:
    """``line`` of a year's documents from shards (``stage0``), a raw dump (``raw``), or shards where there are any (``auto``)."""
    if source not in ("auto", "stage0", "raw"):
        raise ValueError(f"unknown source {source}")
    shards = f"{folder.rstrip('/')}/shards/{year}"
    if source == "stage0" or source == "auto" and storage.is_folder(shards):
        return read_zst_lines(spark, list_shards(shards, year)).select("line")
    return read_raw_dump(spark, find_raw_dump(f"{folder.rstrip('/')}/raw/{year}"))


def read_claims(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Claims partitioned by snapshot_year; a year prunes the partitions read."""
    rows = spark.read.parquet(path)
    return rows if year is None else rows.filter(F.col("snapshot_year") == year)


def read_truth(spark: SparkSession, path: str, truth_type: str | None = None, grain: str = "best", anchors: list[str] | None = None) -> DataFrame:
    """Truth rows of a grain (``best`` or ``all_active``), pruned by the partitions snapshot_year, truth_type, grain, anchor_date."""
    rows = spark.read.parquet(path).filter(F.col("grain") == grain)
    if truth_type:
        rows = rows.filter(F.col("truth_type") == truth_type)
    return rows.filter(F.col("anchor_date").cast("string").isin(anchors)) if anchors else rows


def truth_file_parts(name: str) -> tuple[str, str] | None:
    """(truth type, anchor date) of a file name of the older layout; None for others and for files of all active rows."""
    m = re.fullmatch(r"truth_(temporal|timeless)_anchor=(\d{4}-\d{2}-\d{2})\.parquet", name)
    return (m.group(1), m.group(2)) if m else None


def read_chains(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Chains from JSON lines; blank and unparsable lines drop out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
