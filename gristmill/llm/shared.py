"""The shared folder that every executor and the driver can read, and tables written to it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; only where that is unset (tests, local runs) a temporary one."""
    named = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"{CONF} must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="gristmill-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again.

    It cuts the lineage: lost executors cost a reread, never the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gristmill/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


#: Ids that may be sent to every executor, some bytes each.
FEW_IDS = 500_000


def by_size(ids: DataFrame, few: int = FEW_IDS) -> DataFrame:
    """A written table of ids, marked for broadcast if it is counted and small; else joins with it shuffle, and nothing is sent everywhere."""
    from pyspark.sql import functions as F

    return F.broadcast(ids) if ids.count() <= few else ids


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "written_to", None):
            _delete(table.sparkSession, path)


def drop_written(spark: SparkSession) -> None:
    """Deletes what `written` has left in the shared folder for this application."""
    _delete(spark, f"{shared_dir(spark)}/gristmill/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
