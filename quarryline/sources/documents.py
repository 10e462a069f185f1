"""Documents from files: text, HTML as text, and formats that a plug-in reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that are read, whatever their case.
SUFFIXES = (".pdf", ".txt", ".md", ".html", ".htm", ".csv", ".log")
#: bytes of a file -> texts of its pages, in order.
PageReader = Callable[[bytes], list[str]]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def scan(spark: SparkSession, folder: str, recursive: bool = True, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, name, size, content) of the files of a folder with those suffixes; contents are read only where they are used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    kept = files.where(suffix(F.col("path")).isin(*suffixes))
    return kept.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), "content")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they aren't valid UTF-8."""
    return F.coalesce(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")), F.decode(content, "ISO-8859-1"))


def pages(files: DataFrame, readers: dict[str, PageReader] | None = None) -> DataFrame:
    """(path, name, page from 1, text). Text formats are one page, markup and all. ``readers`` gives functions for other
    suffixes (.pdf): their blank pages are left out and keep their numbers. A suffix without a reader is an error."""
    readers = readers or {}
    kind = suffix(F.col("path"))
    plain = files.where(~kind.isin(".pdf", *readers)).select("path", "name", F.lit(1).alias("page"), decoded(F.col("content")).alias("text"))
    other = files.where(kind.isin(".pdf", *readers)).select("path", "name", kind.alias("kind"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], []]
            for path, name, k, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k not in readers:
                    raise ValueError(f"no reader for {k}: {path}")
                for i, text in enumerate(readers[k](content), 1):
                    if text.strip():
                        for column, value in zip(out, (path, name, i, text), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], ["path", "name", "page", "text"])

    return plain.unionByName(other.mapInArrow(run, "path string, name string, page int, text string"))
