"""Session helpers: table access, shared scratch tables, connected components.

Everything an operator has to keep between jobs goes to the folder that the
cluster names in ``spark.checkpoint.dir`` (shared by all executors), never to a
machine-local temporary folder and never to a local checkpoint, so a lost
executor costs a re-read and not the job.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sound_unions(spark: SparkSession) -> None:
    """Keeps a union from claiming the partitioning of its inputs.

    Spark 4.1 lets a union of equally partitioned inputs skip the next shuffle. Where
    adaptive execution has coalesced the inputs differently, groups are then split
    over tasks and windows and aggregates give wrong results.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (a file or a folder of part files)."""
    sound_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder. Where none is named, a local folder serves a local session; a cluster must name one."""
    sound_unions(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = have.get() if have.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ragstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """``(file system, path)`` of a Hadoop path string."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def spread(scan: DataFrame) -> DataFrame:
    """A scan (with narrow steps on it), dealt out anew only if its files make fewer splits than half the cores.

    A large input has many splits and passes through untouched; one small file
    in front of an expensive Python step would otherwise keep a single core
    busy. Splits are reckoned from the file sizes: nothing is run. Frames that
    read no file pass through.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = scan.inputFiles()
    if not files or len(files) * 2 > cores:
        return scan
    conf = spark._jsparkSession.sessionState().conf()
    sizes = [fs.getFileStatus(p).getLen() for fs, p in (hadoop_path(spark, f) for f in files)]
    opening = conf.filesOpenCostInBytes()
    split = min(conf.filesMaxPartitionBytes(), max(opening, (sum(sizes) + opening * len(sizes)) // cores))
    splits = sum(max(1, -(-n // split)) for n in sizes)
    return scan if splits * 2 > cores else scan.repartition(cores)


def _scratch(spark: SparkSession) -> str:
    """This application's scratch folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/scratch/{spark.sparkContext.applicationId}"
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


_SCOPES: list[list[str]] = []


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps columnar pruning and size
    statistics for the joins that follow.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables written inside the ``with``; results must be written or counted before it ends."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; frames that were built on them must not be used any more."""
    fs, p = hadoop_path(spark, _scratch(spark))
    fs.delete(p, True)


def _is_stars(e: DataFrame) -> bool:
    """Every node hangs on one root, and no root hangs on another."""
    twice = e.groupBy("u").count().where("count > 1").select("u")
    inner = e.join(e.select(F.col("u").alias("r")).distinct(), F.col("v") == F.col("r"), "left_semi").select("u")
    return twice.unionByName(inner).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of an undirected edge list; component = smallest node id.

    Large-star / small-star contraction (Kiveris et al., SoCC 2014): each round
    is two aggregations with map-side combine plus joins, no node ever gathers
    its neighbours in one task, and the number of rounds is logarithmic in
    practice. Nodes without an edge are not returned. Null ends are dropped.
    """
    spark = edges.sparkSession
    e = (
        edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = materialize(e, "cc")
    for _ in range(max_rounds):
        if _is_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours move to the smallest one
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours (and the node itself) move to the smallest one
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        e = materialize(small, "cc")
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
