"""SparkSession helpers.

The library never creates its own session inside an operator; these helpers are
for tests, the bench and the driver entry point.  Cluster deployments pass their
own session and their own ``spark.checkpoint.dir`` (a shared folder); we only
fill that setting in when it is unset, as in local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes (this is
# the checked-size broadcast path), splits skewed join partitions and coalesces
# small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "netgeo", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("NETGEO_DRIVER_MEMORY", "8g"))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir; create a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder and is used
    as is; without it this raises.  Locally (tests) a fresh folder under /tmp
    is taken.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    try:
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # not readable on this session
        conf_dir = None
    conf_dir = conf_dir or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # only reached when a local session names no folder (tests)
        conf_dir = tempfile.mkdtemp(prefix="netgeo-ckpt-", dir="/tmp")
        try:
            spark.conf.set("spark.checkpoint.dir", conf_dir)
        except Exception:  # static on some deployments; the context setting suffices
            pass
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df):
    """Cut lineage by writing ``df`` to the session's (shared) checkpoint dir.

    Used for tables that several branches of one plan read (the cleaned lookup
    table, the distinct query values): they are computed once, survive executor
    loss, and stop the optimizer from inlining large upstream expressions into
    every consumer.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
