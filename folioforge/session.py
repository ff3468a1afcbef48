"""Session helpers shared by every part of the library."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Rows in an Arrow batch. Rows may carry whole files or very long texts, so batches are small.
BATCH_ROWS, BATCH_BYTES = "512", "16m"


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session ready: small Arrow batches, and the package's code on every executor.

    The code is sent once a context, as spark-submit's --py-files does, so that the
    workers need no installed copy.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_folioforge_shipped", None) is None:
        folder = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, folder, True)
        to = os.path.join(folder, "folioforge_code.zip")
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, str(p.relative_to(PACKAGE.parent)))
        sc.addPyFile(to)
        sc._folioforge_shipped = to
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the cluster has cores, where it has fewer: for work that costs far more than moving its rows.

    A large input has more partitions than that and stays as it is, and so does what comes from
    a shuffle, whose partitions aren't known yet.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only where the session names none, as in tests on one machine, a local one is set; on a
    cluster that is an error, as executors don't share the driver's folders.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="folioforge-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: later stages and lost executors reread it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_table(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/folioforge-{uuid.uuid4().hex}/{name}"
