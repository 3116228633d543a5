"""Tables that cut lineage, written to the folder the cluster shares.

The folder is spark.checkpoint.dir of the session. Where it is unset a folder of our
own is set, on a single machine only: on a cluster every executor would write to its
own disk. Each table gets a fresh name, so a rerun never reads an older run's rows.
drop() deletes a table that nothing reads any more; release() those of a session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

GROUP_BYTES = 16 << 20  # of Parquet's row groups: what a writing task holds in memory
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new local folder where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            at = held.get()
        elif spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            at = tempfile.mkdtemp(prefix="textveil-checkpoints-")
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/textveil-{uuid.uuid4().hex}/{name}"
    _written.append(path)
    return path


def table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    Spark deletes the shuffle files of the write as it ends: the table stands for them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("parquet.block.size", GROUP_BYTES)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the list of written tables, for since()."""
    return len(_written)


def since(place: int) -> list[str]:
    return _written[place:]


def _reads(df: DataFrame) -> set[str]:
    """The folders under the shared one that df reads."""
    return {part for file in df.inputFiles() for part in file.split("/") if part.startswith("textveil-")}


def drop(*tables: DataFrame) -> None:
    """Delete tables that were written here and that nothing reads any more."""
    for df in tables:
        own = _reads(df)
        _delete(df.sparkSession, [p for p in _written if p.split("/")[-2] in own])


def release(spark: SparkSession, paths: list[str] | None = None, but: DataFrame | None = None) -> None:
    """Delete the tables that this process wrote, or these; frames read from them end with it.

    but: nothing is deleted of what this frame reads.
    """
    kept = _reads(but) if but is not None else set()
    _delete(spark, [p for p in (_written if paths is None else paths) if p.split("/")[-2] not in kept])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(paths):
        folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(conf).delete(folder, True)
        if path in _written:
            _written.remove(path)
