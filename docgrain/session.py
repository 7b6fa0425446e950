"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE splits the partitions of a hot join key at run time; every join in the package has a
# side that is unique on its key, which is the case AQE can split.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Spark 4.1 may take a union of broadcast joins for partitioned by a key it is not partitioned by, and
    # a group then comes out more than once.
    "spark.sql.unionOutputPartitioning": "false",
}


_staged: list[str] = []


def tune(spark: SparkSession, local_folder: bool = False) -> SparkSession:
    """Set the runtime SQL options and return the session.

    With ``local_folder``, a session in local mode that names no shared folder gets one of its own,
    which goes when the process ends. A cluster has to name one that every machine reaches.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    one_machine = spark.sparkContext.master.split("[")[0] == "local"
    if local_folder and one_machine and not spark.conf.get("spark.checkpoint.dir", None):
        root = tempfile.mkdtemp(prefix="docgrain-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A path of its own under :func:`shared_dir` for one run of one job."""
    return f"{shared_dir(spark)}/docgrain/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    For a result that several outputs start from: it is computed once, lost executors do not
    lose it, and each output reads only the columns it needs.
    """
    path = work_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete what :func:`stage` has written so far. Call it when no result of the job is read any
    more; results are lazy and read staged data until then."""
    jvm = spark.sparkContext._jvm
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
