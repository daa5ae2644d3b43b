"""A shared folder for tables and files that a job writes and reads again."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; a local folder is made only where none is set and Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df, name: str = "kept"):
    """The rows of df, written once to the shared folder: what several branches of a plan use is not computed again."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
