"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job wants; cluster sizing (executors, memory) stays with spark-submit.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

MAX_SHUFFLE_PARTITIONS = 50_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(
    app: str = "metricloom",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sized_for(input_bytes: int, partition_bytes: int = 128 * 1024**2) -> dict[str, str]:
    """Settings for a job over this much input.

    Shuffles start with one partition per ``partition_bytes``, but at most
    ``MAX_SHUFFLE_PARTITIONS`` larger ones: blocks grow with the square of the number and
    the driver keeps a status per map task. AQE merges partitions that turn out small.
    """
    partitions = min(MAX_SHUFFLE_PARTITIONS, max(200, -(-input_bytes // partition_bytes)))
    shuffled = max(partition_bytes, -(-input_bytes // partitions)) if partitions == MAX_SHUFFLE_PARTITIONS else partition_bytes
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(shuffled),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
    }


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings results depend on (UTC, last map key wins)."""
    for key in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        if spark.conf.get(key) != DEFAULT_CONF[key]:
            spark.conf.set(key, DEFAULT_CONF[key])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a fresh temporary folder: there
    driver and executors are one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="metricloom-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint`` usable and return the folder it writes to."""
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
        current = spark.sparkContext.getCheckpointDir()
    return current


def new_work_folder(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder for streaming sinks and state."""
    root = ensure_checkpoint_dir(spark)
    unique = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    return os.path.join(root, f"{label}-{unique}")
