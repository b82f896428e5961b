"""Spark session construction and the shared checkpoint folder.

Library code never builds its own session; callers pass one in.  These
helpers exist for tests, ``bench.py`` and command-line use.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None,
    *,
    app_name: str = "tessera",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with the settings the operators are tuned for.

    AQE stays on so shuffle partition counts, skewed joins and broadcast
    decisions are re-planned at run time from real sizes.  The UI is off.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment and must be shared
    storage; without it this is an error.  Only a local master (one process:
    tests, local runs) gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = configured.get() if configured.isDefined() else None
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share.")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def _memory_mb(text: str) -> int:
    text = text.strip().lower()
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    if text and text[-1] in "kmgt":
        return int(float(text[:-1]) * units[text[-1]])
    if text.endswith("b") and text[-2:-1] in "kmgt":
        return _memory_mb(text[:-1])
    return int(text)  # Spark reads a unit-less size as MiB


def fit_parallelism(spark, requested: int | None = None, per_fit_mb: int = 768) -> int:
    """Concurrent model fits the driver can hold: tree learners keep up to
    256 MB of split statistics per fit on the driver, so the pool size
    follows ``spark.driver.memory`` (default 1g -> 1) and never exceeds 4."""
    memory = _memory_mb(spark.conf.get("spark.driver.memory", "1g"))
    allowed = max(1, min(4, memory // per_fit_mb))
    return allowed if requested is None else max(1, min(requested, allowed))
