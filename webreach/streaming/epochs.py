"""Tables written epoch by epoch: ``<path>/epoch=<n>``.

An epoch's folder is overwritten when the epoch is replayed, and an epoch reads
only the folders of earlier ones, so a replay gives the same rows again. No
state is held by the stream itself."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(os.path.join(path, f"epoch={epoch}"))


def read(spark: SparkSession, path: str, schema: str | StructType, before: int | None = None) -> DataFrame:
    """All epochs' rows, or those of epochs ``before`` one, with their ``epoch``."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
    schema = schema.add("epoch", IntegerType())
    if exists(spark, path):
        rows = spark.read.schema(schema).parquet(path)
    else:  # a plan without tasks
        rows = spark.range(0).filter("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    return rows if before is None else rows.filter(F.col("epoch") < before)
