"""Session helpers: a local session for tests/bench and shared scratch paths.

Everything the library writes (stage caches, snapshots, checkpoints) goes under
the folder the cluster names in ``spark.checkpoint.dir``.  Only when that is
unset (local tests, the bench) do we pick a private folder ourselves.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

_LOCAL_DIR: dict[int, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session used by tests and the bench (``local[n]``)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("nearfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 << 20))
        .config("spark.python.worker.reuse", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    Reads ``spark.checkpoint.dir`` / the context's checkpoint dir; if neither
    is set (local runs), sets a private one once per context.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = id(sc)
    if key not in _LOCAL_DIR:
        _LOCAL_DIR[key] = tempfile.mkdtemp(prefix="nearfold-ckpt-")
        sc.setCheckpointDir(_LOCAL_DIR[key])
    return sc.getCheckpointDir() or _LOCAL_DIR[key]


def scratch_path(spark: SparkSession, *parts: str, fresh: bool = True) -> str:
    """A path under the shared checkpoint folder; ``fresh`` adds a unique leaf."""
    base = checkpoint_dir(spark).rstrip("/")
    leaf = list(parts)
    if fresh:
        leaf.append(uuid.uuid4().hex[:12])
    return "/".join([base, "nearfold", *leaf])


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when a finished snapshot (one with its ``_SUCCESS`` marker) is at ``path``.

    Local paths are checked directly; on a cluster file system the marker is
    read through Spark's own file reader, so a half-written folder never
    counts as a finished stage."""
    if "://" not in path or path.startswith("file:"):
        local = path.split("file:", 1)[-1]
        return os.path.exists(os.path.join(local, "_SUCCESS"))
    try:
        return spark.read.format("binaryFile").load(f"{path.rstrip('/')}/_SUCCESS").select("length").count() == 1
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def reliable_checkpoint(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    The plan is persisted first so the checkpoint write reads the computed
    partitions instead of running the plan a second time; the cache is
    released once the checkpoint files exist."""
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()


def spread(df):
    """Round-robin a scan that has fewer partitions than the cluster has cores.

    For CPU-heavy per-row stages (regex sentence cutting, encoders) on inputs
    stored as a few large row groups.  Big inputs already have many more
    splits than cores, so this is a no-op at scale and never shuffles them."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``nearfold`` importable in executor Python workers (once per application).

    Arrow-batched stages run package functions inside tasks; the package is
    zipped on the driver and distributed with ``SparkContext.addPyFile`` —
    what ``spark-submit --py-files`` does — so workers need no install."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import nearfold

    pkg_dir = os.path.dirname(os.path.abspath(nearfold.__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="nearfold-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
