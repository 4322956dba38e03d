"""Session helpers shared by every job: the shared folder, cut points in the lineage, worker imports."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and runs on one machine is a temporary folder made and set; on
    a cluster a folder of the driver's own would lose what executors write, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-loomwell-")
        atexit.register(shutil.rmtree, base[len("file://") :], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back.

    The lineage ends here, so a lost executor costs no recomputation of what came before, and
    several consumers read only the columns they need.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that executors and Python workers hold of a task at a time. Rows are whole texts here, of which Spark's 10,000 take tens of MB on either side.
_BATCH_ROWS, _BATCH_CONF = "2000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder it was loaded from, and send them rows in batches that suit texts.

    A session's own size of batches is left as it is.
    """
    if spark.conf.get(_BATCH_CONF) == "10000":
        spark.conf.set(_BATCH_CONF, _BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, column: str, most: int = 64 << 20) -> int:
    """The session's number of shuffle partitions, or more, so that none holds above about ``most`` bytes of a column."""
    size = df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(partitions(df.sparkSession), math.ceil(size / most))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until df has no column of that name (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
