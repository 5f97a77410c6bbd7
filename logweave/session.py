"""Session helpers: one place for the configuration the engine expects.

Everything in the library works on a session it is handed; this module only
builds one for tests, the bench and scripts, and resolves the shared folder used
to cut lineage (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# The state store that streaming state with lists and timers (``streaming.live.fold_events``) needs.
ROCKSDB_STATE = ("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

# Settings the engine relies on.  AQE re-plans joins and coalesces partitions at
# run time; skew handling splits a hot (path, block) partition of a join.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    ROCKSDB_STATE[0]: ROCKSDB_STATE[1],
}


def build_session(
    master: str | None = None,
    app_name: str = "logweave",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Get or create a session with the engine settings (tests, bench, scripts)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(ENGINE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    On a cluster ``spark.checkpoint.dir`` must be set, to storage every executor
    sees; only a session whose executors are this process (local runs and tests)
    gets a temporary folder when it is unset.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    sc = _context(spark)
    if sc is None or not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="logweave-ckpt-", dir=os.environ.get("LOGWEAVE_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def _context(spark):
    """The SparkContext of a classic session; None for a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:
        return None


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``logweave`` importable in Python workers (once per application).

    Functions that run in Python workers (``mapInPandas``, the stateful line
    numbering, the tail data source) are pickled by module reference; the
    package is zipped on the driver and distributed with ``addPyFile`` so
    workers can import it wherever the driver was started from.
    """
    sc = _context(spark)
    if sc is None:
        return
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="logweave-pkg-"), "logweave.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
