"""Writers of claims, truth, label tables, chains, summaries and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: Rows in a file of claims, and columns of the summary.
ROWS_A_FILE = 400_000
SUMMARY = ["context", "grouping", "bucket", "n_turns", "acc1", "acck", "drift1_rate", "driftk_rate", "drift_of_errors", "present_rate", "token_f1", "char3_f1", "k", "n_chains", "final_acc1", "final_acck"]


def write_claims(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by snapshot_year; only the years in ``df`` are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_year").option("maxRecordsPerFile", ROWS_A_FILE).parquet(path)


def write_truth(all_active: DataFrame, best: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Both grains in one table partitioned by snapshot_year, truth_type, grain, anchor_date; only their partitions are replaced."""
    rows = all_active.withColumn("grain", F.lit("all_active")).unionByName(best.withColumn("grain", F.lit("best")))
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_year", "truth_type", "grain", "anchor_date").parquet(path)


def write_label_table(labels: DataFrame, path: str, buckets: int | None = None, name: str = "labels") -> int:
    """The label table, replaced; with ``buckets`` as a table bucketed by id, so that joins on id need no shuffle. Gives its row count."""
    if buckets:
        labels.write.mode("overwrite").bucketBy(buckets, "id").option("path", path).saveAsTable(name)
    else:
        labels.write.mode("overwrite").parquet(path)
    return labels.sparkSession.read.parquet(path).count()


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with nested structs; letters beyond ASCII stay as they are."""
    df.write.mode(mode).json(path)


def write_json_result(groups: dict[str, DataFrame], path: str, **about) -> None:
    """Metric tables (a few rows each) with the run's arguments as one JSON file."""
    result = {**about, "results": {k: [r.asDict(recursive=True) for r in d.collect()] for k, d in groups.items()}}
    storage.write_text(path, json.dumps(result, ensure_ascii=False, indent=1, default=str))


def append_summary(path: str, model: str, context: str, metrics: DataFrame, chains: DataFrame | None = None, k: int = 1) -> None:
    """Rows of ``turn_metrics``, with those of ``chain_metrics`` of the same bucket beside them, appended to a TSV file; ratios with six decimals.

    The header comes only where the file is new. The file is small and written anew, as object stores cannot append.
    """
    whole = {(r["grouping"], r["bucket"]): r for r in chains.collect()} if chains is not None else {}
    text = storage.read_text(path) if storage.exists(path) else "\t".join(["model", *SUMMARY]) + "\n"
    shown = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    for r in metrics.orderBy("grouping", "bucket").collect():
        c = whole.get((r["grouping"], r["bucket"]))
        text += "\t".join(map(shown, [model, context, *(r[x] for x in SUMMARY[1:-4]), k, *((c[x] if c else None) for x in SUMMARY[-3:])])) + "\n"
    storage.write_text(path, text)


def write_manifest(path: str, **about) -> None:
    storage.write_text(path, json.dumps(about, ensure_ascii=False, indent=1, default=str))


def job_totals(outputs: dict[str, DataFrame]) -> dict[str, int]:
    """Number of rows of each output, for a manifest."""
    return {name: df.count() for name, df in outputs.items()}


def is_done(path: str) -> bool:
    """Whether an output was written to its end: Spark's success marker, or for a partition (``.../key=value``) that it is there.

    A write that replaces single partitions leaves no marker; it moves each finished partition into place at its commit.
    """
    held = storage.names(path)
    partition = "=" in path.rstrip("/").rsplit("/", 1)[-1] and any(n.endswith(".parquet") or "=" in n for n in held)
    return "_SUCCESS" in held or partition
