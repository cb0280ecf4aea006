"""Parquet tables by period that are replaced as a whole: a reader sees the old table or the new one, never half of one.

A write makes a folder of its own under the table's path, a folder a period in it, and only then points the file
CURRENT to it, by a rename that replaces the file at once.  A write that dies leaves CURRENT as it was.  Each period is
written by as many tasks as its rows need.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_TASK = 1_000_000
CURRENT = "CURRENT"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and paths on it."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    make = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return jvm, conf, make(path).getFileSystem(conf), make


def current(spark: SparkSession, path: str) -> str:
    """The folder that the table is read from."""
    _, _, fs, make = _files(spark, path)
    if not fs.exists(make(f"{path}/{CURRENT}")):
        raise ValueError(f"no table at {path}")
    return f"{path}/{spark.read.text(f'{path}/{CURRENT}').first()[0]}"


def _point(spark: SparkSession, path: str, name: str) -> None:
    jvm, conf, fs, make = _files(spark, path)
    out = fs.create(make(f"{path}/{name}.next"), True)
    out.write(bytearray(name.encode()))
    out.close()
    whole = fs.makeQualified(make(path))
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf).rename(make(f"{path}/{name}.next"), make(f"{path}/{CURRENT}"), options)


def write(df: DataFrame, path: str, key: str, rows_a_task: int = ROWS_A_TASK) -> None:
    """Replaces the table at path by df, which has a column period; rows of a task are in order of key.

    The folder that was current before stays for readers that have begun; older ones go.
    """
    spark = df.sparkSession
    tasks = df.groupBy("period").agg(F.ceil(F.count("*") / rows_a_task).alias("_tasks"))
    share = F.pmod(F.xxhash64(key), F.col("_tasks"))
    dealt = df.join(F.broadcast(tasks.withColumnRenamed("period", "_p")), F.col("period").eqNullSafe(F.col("_p"))).withColumn("_share", share)  # one row a period
    name = f"v-{uuid.uuid4().hex}"
    dealt.repartition("period", "_share").drop("_p", "_tasks", "_share").sortWithinPartitions("period", key).write.partitionBy("period").parquet(f"{path}/{name}")
    _, _, fs, make = _files(spark, path)
    before = current(spark, path).rsplit("/", 1)[1] if fs.exists(make(f"{path}/{CURRENT}")) else None
    _point(spark, path, name)
    for found in fs.listStatus(make(path)):
        old = found.getPath().getName()
        if old.startswith("v-") and old not in (name, before):
            fs.delete(found.getPath(), True)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))
