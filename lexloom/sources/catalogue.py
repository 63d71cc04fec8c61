"""Catalogues of items and their files: JSON documents {"identifier": ..., "files": [{"name": ..., "format": ...}, ...]}.

They are read by Spark, so any store that it reads will do. A catalogue that is reached over a network has first to be
stored as such documents; nothing is fetched here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "identifier string, files array<struct<name:string,format:string,size:string,md5:string>>"


def items(spark: SparkSession, path: str) -> DataFrame:
    """(item, name, format, size, md5): the files of each item."""
    found = spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.col("identifier").alias("item"), F.inline("files"))
    return found.withColumn("size", F.col("size").cast("bigint"))
