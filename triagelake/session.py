"""Spark session with the settings that the engine's results rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "triagelake", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; the cluster's own settings win where they are set."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one in a local run or a test, and only there."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for what outlives a lost one")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="triagelake-scratch-")
    return _LOCAL[app]


def settled(df: DataFrame) -> DataFrame:
    """df as a written table: what builds on it plans a scan, and a lost executor costs no recomputation. It stays until discard()."""
    path = f"{scratch(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes what settled() has written in this process, and says how many tables; frames that read them are then void."""
    conf, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone
