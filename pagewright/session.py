"""Session helpers: table loading, reliable checkpoints, partition counts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables of ``written`` that are not released yet.
_KEPT: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster no executor could read it, so that fails.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagewright-"))
    return sc.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder; partitions and their order stay as they are.

    The stage after the last shuffle is computed twice, so a frame with much work there is better ``written``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder.

    Computed once. For loops too: a checkpointed frame keeps the constraints the optimizer inferred, which grow from round to round; a
    table that is read again has none.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    _KEPT.add(path)
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _KEPT.discard(name)


def release(*frames: DataFrame) -> None:
    """Delete the tables of frames from ``written`` that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._written_to)


def release_all(spark: SparkSession) -> None:
    """Delete every table of ``written`` that is left, once the results that read them are stored."""
    for name in sorted(_KEPT):
        _delete(spark, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a source of few files gives fewer partitions; large sources are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
