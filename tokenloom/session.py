"""Session settings and the shared scratch area."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A session for tests and benchmarks. On a cluster use the cluster's own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tokenloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Without that setting a temporary folder is used, but only on a local master:
    on a cluster a machine's own folder would be lost with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/tokenloom-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tokenloom-")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[app], True)
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used before."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage at a place where the input would otherwise be recomputed by
    every later pass, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A bucket's rows, and what is made of them, are sorted in one task: several times this size.
BUCKET_BYTES = 16 * 1024 * 1024
MAX_BUCKETS = 131_072


def default_buckets(df: DataFrame) -> int:
    """Number of ordered buckets for a running total over ``df``.

    One for every 16 MB of the tables read. A small input gets as many buckets as
    there are cores, or the session's shuffle width if that is less. Where a size is
    not known, the number of tasks that read the input stands for it.
    """
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = min(width, spark.sparkContext.defaultParallelism)
    size = input_bytes(df)
    wanted = df.rdd.getNumPartitions() if size is None else size // BUCKET_BYTES
    return max(1, few, min(MAX_BUCKETS, wanted))


def input_bytes(df: DataFrame) -> int | None:
    """Size of the tables a plan reads, by Spark's estimate; None if one of them is unknown."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if all(size < 1 << 62 for size in sizes) else None


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Redistribute a scan that has fewer tasks than the session has cores.

    Happens with few small files or with large row groups; a table of many files
    is returned as it is. The key has to be close to unique.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)
