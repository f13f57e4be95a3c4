"""Session helpers.

The engine never creates machine-local scratch space on a cluster: lineage is
cut with tables in the directory the cluster names in ``spark.checkpoint.dir``.
Only when that setting is absent and the master is local (tests, a laptop) do
we point it at a fresh folder under /tmp; on a cluster its absence is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings the engine relies on.
ENGINE_CONF = {
    # JSON-LD: Python's json keeps the last of duplicate keys; so does variant
    # parsing once duplicates are allowed.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # pages are wide (whole HTML documents): a 4096-row vectorized batch of
    # 1 MB pages would be 4 GB; keep batches small and splits CPU-sized
    # (the page pass is regex-bound, not IO-bound)
    "spark.sql.parquet.columnarReaderBatchSize": "256",
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(64 * 1024 * 1024),
}

# Of these, the ones that results rest on.
RESULT_CONF = ("spark.sql.variant.allowDuplicateKeys", "spark.sql.session.timeZone")


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "webreach", source_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if source_partitions:
        builder = builder.config("webreach.source.partitions", str(source_partitions))
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the engine needs to an existing session;
    settings that the session has been given stay, but for those that results rest on."""
    given = spark.conf.getAll
    for k, v in ENGINE_CONF.items():
        if k in RESULT_CONF or k not in given:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    from webreach.functions import sqlfns
    sqlfns.ensure(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="webreach-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return conf_dir


_WRITTEN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, mode: str = "table") -> DataFrame:
    """Reuse an intermediate that several joins read.

    ``table``: written once as parquet into the shared checkpoint folder and
    read back (lineage cut, column pruning and filter pushdown on reuse, and
    it survives lost executors); ``drop_tables`` removes it when its results
    are no longer read. The shuffle files of the write go as soon as it ends.
    ``none``: leave it to Catalyst.
    """
    if mode == "none":
        return df
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"webreach-{uuid.uuid4().hex}")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Remove the intermediate tables written so far; results that were not
    written elsewhere can't be read after this. Returns their number."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
