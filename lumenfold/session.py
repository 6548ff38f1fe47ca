"""Session helpers: shared folder, size checks before broadcasting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it has at most this many rows, which is checked by reading one row more.
BROADCAST_ROWS = 20_000
# ... and at most so many bytes.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only for local sessions that name none."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return shared


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, for tables that several jobs need: no job repeats its lineage."""
    return settled_at(df, name)[0]


def settled_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same with the folder, for tables that `removed` drops before the session ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def join_stats(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner",
               salts: int = 32, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Attach one-row-per-key statistics to a large table without moving a hot key to one task.

    The statistics are computed once, up to one row beyond the bound. Within the bounds of rows and bytes they become a local table and
    are broadcast, so the large side is not shuffled. Beyond it they are copied over a fixed number of salts and the
    large side is salted per row, which splits every key.
    """
    head = stats.limit(rows + 1).toArrow()
    if head.num_rows <= rows and head.nbytes <= most_bytes:
        return df.join(F.broadcast(df.sparkSession.createDataFrame(head, stats.schema)), keys, how)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).cast("int"))
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, keys + ["_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin over the session's shuffle partitions, ahead of work that is heavy per row.

    A number of partitions that is asked for is not merged by adaptive execution, which only looks at bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
