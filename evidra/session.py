"""The folder that driver and executors share, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``.

    A session that runs on one machine only (tests) and does not name one
    gets a temporary folder; anywhere else a missing setting is an error,
    as executors would write where the driver finds nothing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="evidra-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/evidra-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    That cuts the lineage: later stages read files that outlive any
    executor, so a lost executor costs its running tasks only.
    """
    spark = df.sparkSession
    path = f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path  # type: ignore[attr-defined]
    return table


def drop_cut(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` returned and nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._cut_path)  # type: ignore[attr-defined]


def drop_all_cuts(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote in this application; for when its results have been written elsewhere."""
    _delete(spark, _run_folder(spark))
