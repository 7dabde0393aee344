"""Tables in the folder that a cluster shares: where plans of several passes start anew, also after an executor is lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that spark.checkpoint.dir names; it goes with the application, or earlier by `drop`.

    Where the setting is empty, a temporary folder is made in local mode alone.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="pulsegrid-")
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{named}/{name}-{uuid.uuid4().hex}")
    made.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(made)
    return made.toString()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder."""
    at = folder(df.sparkSession, "table")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop(*tables: DataFrame) -> None:
    """Removes tables made by `written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            if path.getName().startswith("table-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
