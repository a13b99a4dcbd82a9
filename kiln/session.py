"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "kiln", shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every kiln job expects.

    AQE stays on so joins pick broadcast only when the measured side is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and skewed shuffle
    partitions get split at run time.

    A master is set only when one is passed, so that the one given to spark-submit (or the default) holds.
    The shuffle partition count is set small (twice the cores) only for a
    local master. On a cluster it is left to the cluster's settings or to
    :func:`size_shuffle`: AQE can merge partitions but never makes more than
    the first shuffle has, so a small number would cap a 100 TB shuffle.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master) if master else SparkSession.builder
    builder = (
        builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KILN_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call-site capture costs JVM round trips per Column call; plans here are built from many Columns
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    partitions = shuffle_partitions_for(master, shuffle_partitions, int(cpus))
    if partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_partitions_for(master: str | None, requested: int | None, cores: int) -> int | None:
    """Shuffle partitions to set: the requested number, twice the cores on a local master, else none."""
    if requested:
        return requested
    return 2 * cores if (master or "").startswith("local[") else None


def size_shuffle(spark: SparkSession, input_bytes: int, partition_bytes: int = 256 * 1024 * 1024) -> int:
    """Set ``spark.sql.shuffle.partitions`` so a full shuffle of ``input_bytes`` lands near
    ``partition_bytes`` per partition (at least twice the cores); AQE then coalesces
    what turns out smaller and splits skewed partitions. Returns the number set.

    100 TB at 256 MB is about 400,000 partitions: sized for the first, largest
    shuffle; later, pre-aggregated shuffles are coalesced by AQE.
    """
    cores = spark.sparkContext.defaultParallelism
    n = max(2 * cores, -(-input_bytes // partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(partition_bytes))
    return n


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder every executor can reach: under ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is used as is; when it
    is missing there, this raises rather than fall back to a folder only one
    machine sees. Only on a local master with the setting unset (tests,
    local runs) a private folder is made and set, so ``DataFrame.checkpoint()``
    and written tables land in the same place.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach (shared storage)")
        root = tempfile.mkdtemp(prefix="kiln-shared-")
        sc.setCheckpointDir(root)
    path = "/".join([root.rstrip("/"), *parts]) if parts else root
    return path
