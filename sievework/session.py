"""Session and storage helpers shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "6g", shared: str | None = None) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.config("spark.checkpoint.dir", shared) if shared else SparkSession.builder
    spark = (
        builder.master(f"local[{cores}]")
        .appName("sievework")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by spark.checkpoint.dir. Where it is unset a local session gets a temporary one; a cluster has no such thing."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _OWN.get(app)
        if where is None:
            folder = tempfile.mkdtemp(prefix="sievework-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            where = _OWN[app] = "file://" + folder
    return where.rstrip("/")


_SCRATCH: dict[str, list[str]] = {}
#: What remembers tables under fresh paths, to be emptied with them.
REMEMBERED: list[dict] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/sievework/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete all that this application has put under fresh paths; frames that read from there can't be used any more."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for known in REMEMBERED:
        known.clear()
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a written table in the shared folder; survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def attach(df: DataFrame, one: DataFrame) -> DataFrame:
    """The columns of a one-row table on every row, as scalar subqueries: computed once, no join."""
    return df.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])


#: Plans whose partitions are those of their source: counting them runs nothing.
_PLAIN = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range", "RelationV2", "Union"}


def _plain(node) -> bool:
    children = node.children()
    return node.nodeName().split(" ")[0] in _PLAIN and all(_plain(children.apply(i)) for i in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per row: a scan of far fewer partitions than there are cores is dealt out over them; any other plan is left as it is."""
    sc = df.sparkSession.sparkContext
    execution = df._jdf.queryExecution()
    if _plain(execution.optimizedPlan()) and execution.toRdd().getNumPartitions() * 2 <= sc.defaultParallelism:
        return df.repartition(sc.defaultParallelism)
    return df
