"""Tables written to the folder that driver and executors share, to cut lineage without a local checkpoint."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; only where the session names none (tests on one machine) a local folder is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    where = path(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
