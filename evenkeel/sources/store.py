"""Files of any store that Spark reads: existence, names, exclusive files, moves. All are single calls of the store; no data passes here."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where it is missing."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of the files that lie directly in a folder, without those whose names begin with ``_`` or ``.``."""
    fs, at = _at(spark, path)
    return {n: s.getLen() for s in fs.listStatus(at) if s.isFile() and not (n := s.getPath().getName()).startswith(("_", "."))}


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """A new file with ``text``; False, and nothing is changed, where one is there already."""
    fs, at = _at(spark, path)
    try:
        out = fs.create(at, False)
    except Exception as e:  # the store's own class; a missing permission is no such case
        if fs.exists(at):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there with all of ``text`` or not at all."""
    part = f"{path}.part"
    fs, at = _at(spark, part)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    move(spark, part, path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def move(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a file or folder; False where ``new`` is there or ``old`` isn't."""
    fs, a = _at(spark, old)
    _, b = _at(spark, new)
    if fs.exists(b) or not fs.exists(a):
        return False
    fs.mkdirs(b.getParent())
    return fs.rename(a, b)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)
