"""Session defaults and the shared working folder.

Everything a job writes (fixture files, report tables, checkpoints, models)
goes below the folder named by ``spark.checkpoint.dir``: on a cluster that is
a shared file system, so a lost executor or a restarted driver finds the data
again.  A machine-local temp folder is only used when the setting is absent,
which is the case in unit tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the reports rely on.  AQE re-plans joins from real sizes
# (broadcast only what turned out small), coalesces tiny shuffle partitions and
# splits skewed ones.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


# Opt-in profile for a large cluster (~100 TB of reviews, ~1000 executors).
# Start with many shuffle partitions and let AQE coalesce them to the advisory
# size (an undersized shuffle spills; an oversized one is merged at run time);
# split skewed join partitions; read large files in 256 MB splits.
CLUSTER_PROFILE = {
    "spark.sql.shuffle.partitions": "16000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def build_session(master: str | None = None, app_name: str = "reviewlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None,
                  cluster: bool = False) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if cluster:
        conf.update(CLUSTER_PROFILE)
    conf.setdefault("spark.ui.enabled", "false")
    conf.setdefault("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, registering it with the context.

    The cluster's ``spark.checkpoint.dir`` wins; only when it is unset (tests,
    a laptop) is a fresh local folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="reviewlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A path below the shared checkpoint folder, fresh per call by default."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    leaf = f"{name}-{uuid.uuid4().hex[:12]}" if unique else name
    return f"{base}/reviewlens/{leaf}"
