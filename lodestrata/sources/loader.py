"""Binary content behind URIs: only the URIs are stored, the content is loaded where it is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_uris(spark: SparkSession, records: DataFrame, folder: str, uri: str = "uri", pattern: str = "*") -> DataFrame:
    """``records`` with the ``content`` (binary) of the files below ``folder`` that their ``uri`` names; null where there is none.

    URIs compare by the path below the folder, with or without the folder itself.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    root = folder.split("://")[-1].rstrip("/") + "/"
    tail = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\w+:/*(?=/)", ""), "^" + root.replace(".", r"\."), "")
    found = files.select(tail(F.col("path")).alias("_path"), "content")
    return records.join(found, tail(F.col(uri)) == F.col("_path"), "left").drop("_path")
