"""Files of any storage that Spark can reach (local, HDFS, object stores), by Hadoop's own file systems on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(path: str):
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(path: str) -> bool:
    _, place, files = _at(path)
    return files.exists(place)


def is_folder(path: str) -> bool:
    _, place, files = _at(path)
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def names(folder: str) -> list[str]:
    """Names in a folder, empty where there is none."""
    _, place, files = _at(folder)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if is_folder(folder) else []


def files_below(folder: str) -> list[str]:
    """Paths of all files below a folder, in order."""
    _, place, files = _at(folder)
    if not is_folder(folder):
        return []
    found, out = files.listFiles(place, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(out)


def matching(pattern: str) -> list[str]:
    """Full paths that a pattern matches, in order; of a folder the files in it."""
    _, place, files = _at(pattern)
    out = []
    for s in files.globStatus(place) or []:
        out += files_below(s.getPath().toString()) if s.isDirectory() else [s.getPath().toString()]
    return sorted(out)


def read_text(path: str) -> str:
    spark, place, files = _at(path)
    stream = files.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Replaces a small file."""
    _, place, files = _at(path)
    stream = files.create(place, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
