"""Where intermediate tables live, and how rows travel to Python.

Iterative operators cut their lineage with a table written to the folder that
``spark.checkpoint.dir`` names, which every executor and the driver can read.
Only a plain local session without that setting gets a folder of its own.
Tables that only an operator's own steps read are removed when it is done.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of an Arrow batch sent to Python, where the session leaves Spark's own (larger) bound in force.
BATCH_BYTES, SPARK_BATCH_BYTES = 4 << 20, 64 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI or path without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it."""
    return _write(df, name)[0]


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Scratch:
    """``materialize`` for tables that only an operator's own steps read: they are removed on leaving, or before by ``drop``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for _, path in self.made:
            _remove(self.spark, path)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        scan, path = _write(df, name)
        self.made.append((scan, path))
        return scan

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads, and the shuffle files of the steps so far (Spark does when the driver collects garbage)."""
        for scan, path in self.made:
            if any(scan is t for t in tables):
                _remove(self.spark, path)
        self.made = [x for x in self.made if not any(x[0] is t for t in tables)]
        self.spark._jvm.System.gc()


def map_arrow(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, so that long texts don't make them large."""
    spark = df.sparkSession
    if int(str(spark.conf.get(_BATCH_KEY, str(SPARK_BATCH_BYTES))).rstrip("b")) == SPARK_BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
