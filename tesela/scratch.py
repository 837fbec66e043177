"""Tables that a query writes in order to start anew from files: in the folder that driver and executors share, one folder for each application,
deleted when it ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL = "/tmp/checkpoints"
_ours: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine on a local master, an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(_LOCAL)
    return _LOCAL


def path(spark: SparkSession, tag: str) -> str:
    own = f"{shared_dir(spark)}/tesela-{spark.sparkContext.applicationId}"
    if own not in _ours:
        _ours.add(own)
        atexit.register(_delete, spark, own)
    return f"{own}/{uuid.uuid4().hex}-{tag}"


def _delete(spark: SparkSession, folder: str) -> None:
    """Nothing where the session has ended before: its folder is then left to whoever empties the shared one."""
    if spark.sparkContext._jsc is None:
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df written and read again: later steps start from the files, also after executors are lost."""
    at = path(df.sparkSession, tag)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


# ------------------------------------------------ small texts that readers and writers share

def _where(spark: SparkSession, name: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(name)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, name: str) -> str | None:
    """A small file's text; None where there is none."""
    at, fs = _where(spark, name)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, name: str, text: str) -> None:
    """Writes a text beside and puts it in its place by one renaming, which readers see before or after."""
    at, fs = _where(spark, name)
    beside, _ = _where(spark, f"{name}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), fs.makeQualified(at), over)


def stamp(spark: SparkSession, folder: str, names: list[str]) -> str:
    """Sizes and times of some files or folders of a folder: another text where any has been written anew."""
    out = []
    for name in names:
        at, fs = _where(spark, f"{folder}/{name}")
        if fs.exists(at):
            found = fs.getContentSummary(at)
            out.append(f"{name} {found.getLength()} {fs.getFileStatus(at).getModificationTime()}")
    return "\n".join(out)
