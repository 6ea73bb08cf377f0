"""Sessions and durable intermediate results."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def session(name: str = "rankloom", cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the library is written for; on a cluster, spark-submit sets them."""
    build = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.maxPlanStringLength": "100000",
        "spark.driver.memory": "4g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a cluster needs it too: checkpoints of finished iterations go
        "spark.sql.ui.retainedExecutions": "20",
        "spark.ui.retainedJobs": "50",
        "spark.ui.retainedStages": "50",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        build = build.config(k, v)
    return build.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder: `spark.checkpoint.dir`, or a temporary one where a local session has none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def having(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings; what was set before comes back after it."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: short plans, and lost executors lose nothing.

    The partitioning of df is kept, so a join on the same key needs no new shuffle. The shuffles of df's own plan go
    as soon as it is written, whatever the garbage collector does.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    with having(spark, {FREE_SHUFFLES: "true"}):
        return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """A table that `cut` wrote, without the optimizer's estimate of its size.

    A written table keeps the estimate of the plan it came from, and a join has the product of the estimates of its
    sides. Where a loop joins a table with what it made of it, the digits of that number double with each round: after
    some 20 rounds it fills the driver's memory.
    """
    spark = df.sparkSession
    plan, jvm = df._jdf.queryExecution().analyzed(), spark.sparkContext._jvm
    none = jvm.scala.Option.empty()
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, none, none
    )
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, bare), spark)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a table that `cut` wrote and no later plan reads."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> tuple[DataFrame, int]:
    """df in executor storage, and its number of rows; the shuffles it came from are removed.

    Should an executor be lost, Spark runs the stages before those shuffles again.
    """
    df = df.persist(level)
    n = df.count()
    relation = df._jdf.queryExecution().withCachedData()
    master = df.sparkSession.sparkContext._jsc.sc().env().blockManager().master()
    for i in _shuffles(relation.cacheBuilder().cachedColumnBuffers()):
        master.removeShuffle(i, True)
    return df, n


def _shuffles(rdd) -> list[int]:
    """Ids of the shuffles that an RDD of the JVM is made of; those behind a written or stored RDD are not its own."""
    found, seen, open_ = [], set(), [rdd]
    while open_:
        at = open_.pop()
        if at.id() in seen or (at is not rdd and (at.isCheckpointed() or at.getStorageLevel().isValid())):
            continue
        seen.add(at.id())
        needs = at.dependencies()
        for i in range(needs.size()):
            need = needs.apply(i)
            if need.getClass().getSimpleName() == "ShuffleDependency":
                found.append(need.shuffleId())
            open_.append(need.rdd())
    return found
