"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_ROOTS: dict[str, str] = {}

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # CSV headers that differ only by case are different columns.
    "spark.sql.caseSensitive": "true",
}


INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PARTITIONS_PER_CORE = 8
MAX_PARTITIONS = 40_000


def initial_partitions(cores: int, configured: int) -> int:
    """Shuffle partitions to start from. Adaptive execution merges small ones but never
    splits, so the start must suit the largest shuffle the cluster can run."""
    return max(configured, min(MAX_PARTITIONS, cores * PARTITIONS_PER_CORE))


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator relies on. On a cluster shuffles start with
    a number of partitions that grows with it, unless the session names one."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    local = spark.sparkContext.master.startswith("local")
    if not local and spark.conf.get(INITIAL_PARTITIONS, None) is None:
        start = initial_partitions(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.conf.set(INITIAL_PARTITIONS, str(start))
    return spark


def local_session(cpus: int | str = 8, memory: str = "16g", app: str = "factloom") -> SparkSession:
    """A local[n] session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        # Small test files: let every core read one.
        .config("spark.sql.files.openCostInBytes", "262144")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new sub-folder of the shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL_ROOTS.setdefault(app, tempfile.mkdtemp(prefix="factloom-"))
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df, label: str = "cut"):
    """Write ``df`` to the shared folder and read it back, so a lost executor
    never forces the plan before this point to run again."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One given table; zone-less timestamps become TIMESTAMP (UTC session)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    ntz = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df
