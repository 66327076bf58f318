"""The shared folder: where lineage is cut and working tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the cluster's ``spark.checkpoint.dir`` (or a directory already set on
    the context). Where neither exists, a temporary folder is made and set, but
    only in local mode, as in tests; on a cluster that is an error.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
    made = "file://" + tempfile.mkdtemp(prefix="tracefold-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)


def cut(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, with the lineage cut by a reliable checkpoint.

    The checkpoint is removed once nothing refers to it any more, at the latest
    when the session ends.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    sc = spark.sparkContext._jsc.sc()
    sc.conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if not sc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    delete_at_exit(spark, sc.getCheckpointDir().get())
    return df.checkpoint(eager=True)


class Spool:
    """Working tables of one computation, written to the shared folder.

    ``put`` writes a DataFrame as a Parquet table and reads it back, which cuts
    the lineage and survives the loss of executors. A name that is put again
    replaces the older table once the new one is complete. ``finish`` writes the
    result and removes all other tables; what is left goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
        self._live: dict[str, str] = {}
        self._turn = 0

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self._turn += 1
        path = f"{self.root}/{name}-{self._turn}"
        df.write.parquet(path)
        if self._turn == 1:
            delete_at_exit(self.spark, self.root)
        old, self._live[name] = self._live.get(name), path
        if old:
            delete(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def holds(self, path: str) -> bool:
        return exists(self.spark, path)

    def drop(self, name: str) -> None:
        if old := self._live.pop(name, None):
            delete(self.spark, old)

    def finish(self, df: DataFrame) -> DataFrame:
        """The result as a table of its own; every other table of this computation is removed."""
        out = self.put("result", df)
        kept = self._live["result"].rsplit("/", 1)[-1]
        p, fs = _path(self.spark, self.root)
        for f in fs.listStatus(p):
            if f.getPath().getName() != kept:
                fs.delete(f.getPath(), True)
        self._live = {"result": self._live["result"]}
        return out
