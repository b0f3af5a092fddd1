"""Session services that the operators of this subpackage share.

Intermediate tables are written as Parquet under the folder that the session names in
``spark.checkpoint.dir``; every executor and the driver can read it, so a lost executor costs a re-read and
never the lineage behind the table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only in local mode, where none is named, a local one is made and set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="triloom-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/triloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one run: ``keep`` materialises one, ``drop`` deletes some, ``clear`` all."""

    def __init__(self) -> None:
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(df.sparkSession, label)
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if id(df) in self.paths:
                remove(df.sparkSession, self.paths.pop(id(df))[1])

    def clear(self) -> None:
        self.drop(*[df for df, _ in self.paths.values()])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast(T.StringType()), F.lit(""))
