"""Tables of a folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from gristmill.plans.ship import ship


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(ship(spark).read.parquet(f"{folder}/{name}.parquet"))


#: Bytes of files up to which a table is dealt anew.
SMALL = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores if its files are small and would keep half of the cores idle, a small file in one piece. Larger inputs stay as they are, unshuffled, however many cores there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() > cores or int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SMALL:
        return df
    return df.repartition(cores)


_local: dict[str, str] = {}


def table_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a table that a query stores: in the shared folder of `spark.checkpoint.dir`; only where that is unset, in local runs, in a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="gristmill-tables-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        named = f"file://{_local[app]}"
    return f"{named.rstrip('/')}/gristmill-tables/{app}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in a new folder, read again: what follows may read it twice and sees the same rows with the same numbers, also after executors were lost."""
    path = table_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
