"""Where documents come from. Every reader gives one document per row."""

from __future__ import annotations

import sys
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FORCE = ("mmap", "eager", "buffered")


def read_documents(spark: SparkSession, path: str | list[str], layout: str = "file", force_input: str | None = None, streaming: bool = False) -> DataFrame:
    """(path, json) of each document under path.

    layout "file" takes a file as one document, "lines" a line as one; "binary" reads bytes and decodes them as UTF-8,
    which keeps line ends and a byte-order mark as they are. force_input names an input strategy for compatibility;
    Spark's readers choose their own. streaming reads files as they arrive.
    """
    if force_input is not None and force_input not in _FORCE:
        raise ValueError(f"force_input is one of {', '.join(_FORCE)}")
    reader = spark.readStream if streaming else spark.read
    name = F.col("_metadata.file_path").alias("path")
    if layout == "file":
        return reader.text(path, wholetext=True).select(name, F.col("value").alias("json"))
    if layout == "lines":
        return reader.text(path).where(F.length(F.trim("value", F.lit(" \t\r\n"))) > 0).select(name, F.col("value").alias("json"))
    if layout == "binary":
        source = reader.format("binaryFile")
        if streaming:
            source = source.schema("path string, modificationTime timestamp, length long, content binary")
        return source.load(path).select("path", F.decode("content", "UTF-8").alias("json"))
    raise ValueError("layout is file, lines or binary")


def from_strings(spark: SparkSession, documents: list[str | bytes]) -> DataFrame:
    """(doc_id, json) of documents that the driver holds."""
    rows = [(i, d.decode("utf-8", "surrogateescape") if isinstance(d, bytes) else d) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "doc_id bigint, json string")


def from_stdin(spark: SparkSession, stream: BinaryIO | None = None) -> DataFrame:
    """(doc_id, json): all of standard input as one document."""
    return from_strings(spark, [(stream or sys.stdin.buffer).read()])
