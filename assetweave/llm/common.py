"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a Python worker holds a few MB of text at a time.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine, a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-shared-"))
    return found or spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files behind a frame made by written(), when nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove_path(spark, folder)


def arrow_limits(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, for plans that run after the caller has returned them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Bounds the Arrow batches of what runs within."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, or ones like them that df has no column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def cut_points(df: DataFrame, key: str, pieces: int) -> list:
    """Up to pieces - 1 values of key that split the rows about evenly. Reads that one column."""
    if pieces <= 1:
        return []
    found = df.where(F.col(key).isNotNull()).approxQuantile(key, [i / pieces for i in range(1, pieces)], 1 / (4 * pieces))
    return sorted({int(x) for x in found})


#: Keys that joined_by_size broadcasts, at most; each has over this part of all rows.
HOT_KEYS = 1000


def joined_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows with the columns of groups, which has one row for each key of rows and in size the number of rows that it stands for.

    The keys of over a HOT_KEYS-th of all rows, which can't be more than HOT_KEYS, are broadcast; the others meet in a
    join that shuffles, where none of them is large. Keys aren't null. rows and groups are read twice.
    """
    most = F.broadcast(groups.agg((F.sum(size) / HOT_KEYS).alias("_most")))
    named = groups.join(most).select(*groups.columns, (F.col(size) > F.col("_most")).alias("_hot"))
    hot, cold = named.where("_hot").drop("_hot"), named.where("NOT _hot").drop("_hot")
    few = rows.join(F.broadcast(hot), keys)
    many = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return few.unionByName(many)
