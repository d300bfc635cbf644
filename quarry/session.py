"""SparkSession helpers.

Cluster settings (shuffle partitions, checkpoint dir, memory) belong to the
cluster: we only fill in defaults that are unset, so the same code runs on a
laptop (`local[8]`) and on a 1000-executor cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Independent fits (restarts, sweep points, CV folds, bagged trees) run as
# this many concurrent Spark jobs, like CrossValidator(parallelism=...).
FIT_PARALLELISM = 4

# Defaults applied only when the session does not define them already.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app_name: str = "quarry",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one for tests / bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        _apply_defaults(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
               .config("spark.sql.shuffle.partitions",
                       str(shuffle_partitions or cpus)))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _apply_defaults(spark)
    return spark


def _apply_defaults(spark: SparkSession) -> None:
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared (HDFS/S3/…) folder and we use it
    as is; a cluster session without it is an error. Only a local-mode
    session (tests, local runs) with the setting unset gets a folder of our
    own under the system temp folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            # a machine-local folder is not visible to other executors and
            # is lost with its node: a cluster must name a shared folder
            raise RuntimeError("set spark.checkpoint.dir to a shared folder "
                               "(HDFS, S3, ...) before running multi-pass jobs")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder.

    Used for iterative stages (k sweeps, bagging loops) so that a lost
    executor re-reads the checkpoint instead of replaying a long lineage.
    ``localCheckpoint`` is never used: it does not survive executor loss.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
