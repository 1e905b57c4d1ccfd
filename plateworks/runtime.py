"""Session helpers: shared work folder, lineage cuts and table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plateworks")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PLATEWORKS_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and the master is local (tests on
    one machine) a temporary folder is made, and removed when the process ends; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="plateworks-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return "file://" + _LOCAL["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through Hadoop's file system, so that shared stores work too."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_CUTS: set[str] = set()


class Cut:
    """A table written to the shared folder: it cuts the lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        _CUTS.add(self.path)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)
        _CUTS.discard(self.path)


def sweep(spark: SparkSession) -> None:
    """Removes all cuts that are left, once no result that reads them is needed any more."""
    while _CUTS:
        delete(spark, _CUTS.pop())


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    return Cut(df, name).df


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(where).getLength()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, wherever they run; once for an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    where = tempfile.mkdtemp(prefix="plateworks-ship-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    name = os.path.basename(here)
    stage = shutil.copytree(here, f"{where}/stage/{name}", ignore=shutil.ignore_patterns("__pycache__"))
    made = shutil.make_archive(f"{where}/{name}-{app}", "zip", os.path.dirname(stage), name)
    spark.sparkContext.addPyFile(made)
    _SHIPPED.add(app)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores before a costly kernel, if it comes in fewer partitions than there are cores.

    Large inputs have partitions enough and pass untouched, so only small tables are shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def numbered(df: DataFrame, order: list[str], to: str) -> DataFrame:
    """df with a running number from 1 in the given order, without one task that sees all rows.

    The rows are sorted by ranges and written once; each part numbers its own rows after the sum of the
    parts before it, a list as long as there are partitions.
    """
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    parts = Cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "sorted").df
    sizes = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    before, at = {}, 0
    for part, n in sizes:
        before[part], at = at, at + n
    if not before:
        return df.withColumn(to, F.lit(0).cast("bigint"))
    start = F.create_map(*[F.lit(x).cast("bigint") for kv in before.items() for x in kv])
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn(to, own + start[F.col("_part").cast("bigint")]).drop("_part")
