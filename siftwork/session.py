"""Session helpers: worker path, shared folder, reliable checkpoints, table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset in a local session a temporary one.

    On a cluster it has to be set: a folder of one machine would lose rows.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("siftwork.local.dir", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="siftwork-")
            spark.conf.set("siftwork.local.dir", folder)
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table in the shared folder."""
    _SCRATCH.append(f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def mark() -> int:
    """The intermediate tables so far, for :func:`release`."""
    return len(_SCRATCH)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete this process's intermediate tables, once no result that reads them is needed; returns how many.

    Of those made after the mark ``since``, all but the last ``keep``.
    """
    conf, n = spark._jsc.hadoopConfiguration(), 0
    end = len(_SCRATCH) - keep
    gone, _SCRATCH[since:end] = _SCRATCH[since:end], []
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write as Parquet in the shared folder and reread: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int = 5_000) -> DataFrame:
    """The rows dealt to tasks of about ``rows`` each by a key without hot values: a small file of narrow rows would be one task, whatever is made of them."""
    return df.repartition(1 + df.count() // rows, key)
