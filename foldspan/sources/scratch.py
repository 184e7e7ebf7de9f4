"""Tables that cut a job's lineage: written once in the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="spark-stored-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is not set, a temporary folder if there is one machine, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    return _temporary() if spark.sparkContext.master.partition("[")[0] == "local" else f"{spark.conf.get('spark.sql.warehouse.dir')}/stored"


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """df, written and read again: what follows is computed from files, also after the loss of an executor."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
