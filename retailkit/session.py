"""SparkSession construction and shared-storage settings."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults for a session we build ourselves (tests, bench).  On a cluster the
# operator's spark-defaults win: ``getOrCreate`` keeps existing settings.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "retailkit") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Session settings that hold inside the block only; what runs there must be an action, as a plan is made with the settings of its time."""
    was = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, str(v).lower() if isinstance(v, bool) else str(v))
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``, or that its SparkContext already uses.

    A folder of our own, on this machine, is taken only in local mode (tests, bench).  On a cluster without a named folder
    this is an error: executors can't share a folder of the driver's machine.
    """
    try:
        sc = spark.sparkContext                     # classic sessions
    except Exception:                               # Spark Connect has none; the setting must be there
        sc = None
    set_now = sc.getCheckpointDir() if sc is not None else None
    d = spark.conf.get("spark.checkpoint.dir", None) or (os.path.dirname(set_now.rstrip("/")) if set_now else None)
    if not d:
        master = sc.master if sc is not None else ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="retailkit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and not set_now:
        sc.setCheckpointDir(d)
    return d
