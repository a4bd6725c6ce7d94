"""Shared plumbing: table access, checkpoint folder, partition sizing."""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made in this process, deleted by ``release`` or at its end.
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Without one a cluster is an error, as a folder of one machine would lose
    rows there.  A local master, whose executors are on this machine, gets a
    folder below ``spark.local.dir``.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = f"file://{spark.sparkContext.getConf().get('spark.local.dir', '/tmp')}/skein-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", conf)
        _keep(conf)
    return conf.rstrip("/")


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through reliable files in the shared folder."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    _keep(spark.sparkContext.getCheckpointDir())
    return df.checkpoint(eager)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder for a written table, until ``release``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _keep(path)
    return path


def _keep(path: str) -> None:
    if path not in _MADE:
        _MADE.append(path)


def release() -> None:
    """Delete all checkpoints and scratch tables of this process; call it once the results are written.

    Results that were not yet written can no longer be read after it.  At the
    end of the process it is called in any case, as far as its JVM still runs.
    """
    jvm = SparkContext._jvm
    if jvm is None:
        return
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        context = SparkContext._active_spark_context
        conf = context._jsc.hadoopConfiguration() if context is not None else jvm.org.apache.hadoop.conf.Configuration()
        path.getFileSystem(conf).delete(path, True)


def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM is gone
        pass


atexit.register(_at_exit)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Sizes from here on are the optimizer's word for not knowing one.
_UNKNOWN = 1 << 55


def size_in_bytes(df: DataFrame) -> int:
    """An estimate of a table's size, 0 if there is none.

    Of one scan, its files scaled to the columns read; of several, the sum of
    the scans, since the estimate of a join is the product of its sides.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    nodes = [plan] if leaves.size() == 1 else [leaves.apply(i) for i in range(leaves.size())]
    sizes = [int(str(n.stats().sizeInBytes())) for n in nodes]
    return sum(n for n in sizes if n < _UNKNOWN)


def parts_for(df: DataFrame, part_bytes: int = 128 << 20, most: int = 100_000) -> int:
    """Partitions for a shuffle of ``df``: as many as the session says, more where one would exceed ``part_bytes``."""
    return max(shuffle_parts(df.sparkSession), min(most, -(-size_in_bytes(df) // part_bytes)))


def latest(df: DataFrame, keys: list[str], at: str = "recorded_at") -> DataFrame:
    """Row rule: of the rows with one key, the one with the latest ``at``.

    Rows with a null key drop out; a null ``at`` is the earliest.  Of exact
    ties in ``at`` the greatest row in the order of the other columns stays
    (with a map among them, any one), so that the result is fixed.
    Aggregated with a map-side combine, so that the re-deliveries of a key,
    however many, meet before the shuffle.  A struct has no fixed width, so
    Spark sorts each partition by key for it, on either side of the shuffle;
    select the columns that are needed first.
    """
    rest = [c for c in df.columns if c not in keys and c != at]
    maps = any("map<" in kind for name, kind in df.dtypes if name in rest)
    row = F.struct(F.col(f"`{at}`"), *[F.col(f"`{c}`") for c in rest])
    out = df.dropna(subset=keys).groupBy(*keys).agg((F.max_by(row, F.col(f"`{at}`")) if maps else F.max(row)).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in [*rest, at]])


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores, before costly work on each row.

    Few files, or a file of few row groups, would leave cores idle; inputs of
    more partitions than cores stay where they are read, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
