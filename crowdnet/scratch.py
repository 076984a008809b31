"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a partition that an aggregation or a sort gets, about: what a task holds is bounded by it at every size.
ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of about so many rows, dealt by keys over at least as many partitions as the session asks for; the optimizer doesn't put them together again.

    An aggregation by these keys then adds up rows once, and not the rows of each large part of a file before.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one JVM (tests).

    On a cluster a folder of one machine would lose tables, so an unset folder is an error there.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="crowdnet-")
        spark.sparkContext.setCheckpointDir(found)
        delete_at_end(spark, found)
    return found.rstrip("/")


class Scratch:
    """Tables written once and read again, which cuts the lineage and survives the loss of an executor.

    What a result still reads stays until the application ends, and is deleted then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/crowdnet-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._count = 0

    def path(self, name: str = "t") -> str:
        if not self._count:
            delete_at_end(self.spark, self.root)
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch = self  # keeps the object alive as long as the table's frame
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later result reads."""
        for df in tables:
            path = self._paths.pop(id(df), None)
            if path:
                delete(self.spark, path)


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _target(spark, path)
    fs.delete(target, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Make the folder and have it deleted when the driver's JVM ends."""
    fs, target = _target(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
