"""Writing tables, indexes, scorecards and files."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragstone.session import hadoop_path, materialize


def recreate(df: DataFrame, path: str, partition_by: list[str] | None = None, dim: int | None = None, vec_col: str = "embedding") -> None:
    """Drop and recreate a Parquet table. With ``dim``, rows whose vector has another length fail the write."""
    if dim is not None:
        ok = F.col(vec_col).isNull() | (F.size(vec_col) == dim)
        df = df.withColumn(vec_col, F.when(ok, F.col(vec_col)).otherwise(F.raise_error(F.lit(f"a vector has not {dim} numbers")).cast(df.schema[vec_col].dataType)))
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Bulk load behind what is there."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Stage a query batch as a cached temporary view."""
    df.cache().createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def with_row_key(df: DataFrame, order: list[str | Column], key: str = "id", buckets: int | None = None) -> DataFrame:
    """A dense key 1..n in the stated order, without a single-task window.

    The rows are dealt into ranges of the order once and written with the number
    of their range; counts and row numbers both read that table, so they speak of
    the same ranges (one count per range reaches the driver). Rows that are equal
    in ``order`` are ordered by a hash of all their columns, which also splits a
    value that a large part of the rows shares. Null values come first. Empty
    input: no rows.
    """
    spark = df.sparkSession
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    part, tie = f"_part_{uuid.uuid4().hex}", f"_tie_{uuid.uuid4().hex}"
    plain = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    tied = df.withColumn(tie, F.xxhash64(*plain) if plain else F.lit(0).cast("long"))
    ranged = materialize(tied.repartitionByRange(n, *order, tie).withColumn(part, F.spark_partition_id()), "keyed")
    counts = {r[part]: r["count"] for r in ranged.groupBy(part).count().collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    if not before:
        return df.withColumn(key, F.lit(None).cast("long"))
    offset = F.element_at(F.create_map(*[x for p, c in before.items() for x in (F.lit(p), F.lit(c))]), F.col(part))
    w = Window.partitionBy(part).orderBy(*order, tie)
    return ranged.withColumn(key, (F.row_number().over(w) + offset).cast("long")).drop(part, tie)


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``current`` whose key is not in ``new``. A null key never matches."""
    return current.join(new.select(key), key, "left_anti").select(current.columns).unionByName(new, allowMissingColumns=True)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str, schema: str) -> DataFrame:
    """Upsert into a stored table: written beside it, the old table moved aside, the new one moved in, the old one deleted last.

    A crash leaves the old table in place or, between the two moves, at ``<path>.old``,
    from where the next call puts it back.
    """
    from ragstone.sources.files import read_scorecard

    base = path.rstrip("/")
    fs, target = hadoop_path(spark, base)
    _, aside = hadoop_path(spark, f"{base}.old")
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        else:
            fs.rename(aside, target)
    merged = upsert(read_scorecard(spark, base, schema), new, key)
    side = f"{base}.{uuid.uuid4().hex}"
    merged.write.parquet(side)
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"could not move {base} aside")
    if not fs.rename(hadoop_path(spark, side)[1], target):
        raise OSError(f"could not move the new table to {base}")
    fs.delete(aside, True)
    return spark.read.schema(schema).parquet(base)


def put_files(df: DataFrame, folder: str, name_col: str, text_col: str, suffix: str = ".md") -> int:
    """One file per row (text or binary), ``<name><suffix>``, written by the executors; returns the number of files.

    ``folder`` is a path or URI of a file system that pyarrow knows (local or
    shared folder, hdfs, s3, gs). A file is written aside and moved in, so a
    retried task leaves whole files. A null text is an empty file, a null name
    none; of several rows of a name the greatest text stays.
    """
    rows = df.select(F.col(name_col).cast("string").alias("name"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")).where("name is not null")

    def run(batches):
        from pyarrow import fs as pfs

        store, root = pfs.FileSystem.from_uri(folder) if "://" in folder else (pfs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for t in batches:
            for name, text in zip(t.column("name").to_pylist(), t.column("text").to_pylist()):
                side = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(side) as out:
                    out.write(text)
                store.move(side, f"{root}/{name}{suffix}")
            yield pa.RecordBatch.from_arrays([pa.array([t.num_rows], pa.int64())], names=["n"])

    return rows.groupBy("name").agg(F.max("text").alias("text")).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def put_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def put_text(df: DataFrame, path: str, text_col: str = "text") -> None:
    df.select(text_col).write.mode("overwrite").text(path)


def display_rows(ranking: DataFrame, text_col: str = "text") -> DataFrame:
    """Rank, distance and a snippet of each result, ready to ``show()``."""
    from ragstone.functions.text import snippet

    return ranking.select("rank", F.round("distance", 4).alias("distance"), snippet(F.col(text_col)).alias("snippet")).orderBy("rank")
