"""Session helpers shared by every job: shared scratch space, cut lineage, code on workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Rows of a part that one task sorts or hashes.
PART_ROWS = 500_000
_shipped: set[tuple[str, str]] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent and Spark runs in this process (a laptop or a test), a
    fresh temporary folder is set for this session; a cluster has to name one that all
    its machines share.
    """
    given = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    sc = spark.sparkContext
    if not given:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all machines of the cluster share")
        given = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(given)
    return given


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def parted(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of so many rows, dealt by the keys into parts of about PART_ROWS. What groups it
    by these keys needs no other shuffle, and a task's memory does not grow with the
    input; without it, a task groups all that it reads of a file."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)), *keys)


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote for df; nothing may read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def importable_on_workers(spark: SparkSession, root: str) -> None:
    """Send the package to the Python workers of this session, once, as one archive."""
    sc = spark.sparkContext
    if (sc.applicationId, root) in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="quarry-"), "quarry.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "quarry")):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, root))
    sc.addPyFile(archive)  # the driver serves it to the executors
    _shipped.add((sc.applicationId, root))
