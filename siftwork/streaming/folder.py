"""A watched folder as a source, and files and a message log as sinks."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    """JPEG files of one folder, not of those below it: path and length."""
    reader = spark.readStream.schema(FILES) if stream else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").load(folder)
    return files.select("path", "length")


def in_name_order(files: DataFrame) -> list[str]:
    """File names of a (small) drained queue."""
    return [r.path for r in files.orderBy(F.element_at(F.split("path", "/"), -1), "path").select("path").collect()]


def send_file(source: str, outbox: str) -> str:
    os.makedirs(outbox, exist_ok=True)
    return shutil.copy(source, outbox)


def send_text(log: str, text: str) -> None:
    with open(log, "a", encoding="utf-8") as f:
        f.write(text.replace("\n", " ") + "\n")
