"""Session settings and the two ways the library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every plan in this library is written for. They are all
# session-level, so they can be applied to a session somebody else created.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; shuffle sizing is left to the cluster's own configuration."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "factweave") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return tune(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder lineage is cut in: the session's own setting, a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="factweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` under the checkpoint folder and read it back.

    A written table survives the loss of executors, ends the lineage of iterative jobs, and gives the
    optimiser real file sizes, which in-memory caching of a long plan does not.
    """
    path = f"{checkpoint_root(df.sparkSession)}/factweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame) -> int:
    """Size the optimiser knows for `df`: file bytes for a plain scan, an upper estimate otherwise."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def input_bytes(df: DataFrame) -> int:
    """Bytes of all tables `df` reads, as the optimiser knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


SPREAD_BYTES_PER_CORE = 16 << 20
#: What the optimiser takes a table to have that it knows nothing of.
UNKNOWN_BYTES = 1 << 62


def spread(df: DataFrame) -> DataFrame:
    """Tasks for costly row work: one per core at least, and one for every SPREAD_BYTES_PER_CORE of input.

    The splits of the input do not follow the work: a file of a few large row groups has as few tasks with rows, however
    many cores there are. An input of unknown size is left as it is.
    """
    cores, size = df.sparkSession.sparkContext.defaultParallelism, input_bytes(df)
    return df if size >= UNKNOWN_BYTES else df.repartition(max(cores, -(-size // SPREAD_BYTES_PER_CORE)))
