"""Binary files through Spark's file systems, which reach every store that its readers do."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def save_bytes(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """Writes the parts one after the other, holding one at a time."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        for part in parts:
            out.write(bytearray(part))
    finally:
        out.close()
