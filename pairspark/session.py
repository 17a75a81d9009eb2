"""Session construction and the shared folder used for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(
    app: str = "pairspark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str = "16g",
) -> SparkSession:
    """Session for tests and benches; on a cluster use the session given by spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", driver_memory)
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Root folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A local session without that
    setting gets a temporary folder; any other session must name one, because a
    machine-local folder is lost with its executor.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if root:
        if not current:
            sc.setCheckpointDir(root)
        return root
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pairspark-"))
    return sc.getCheckpointDir()


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below :func:`shared_dir`."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


class Folder:
    """A folder in whatever file system its path names, for the small files that steer tables."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self) -> list[str]:
        """Names of the files and folders in it, none if it does not exist."""
        at = self._at(self.path)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str | None:
        """The text of a file; none if it is gone."""
        at = self._at(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file so that it appears with all its text, by one rename."""
        draft = self._at(f"{self.path}/.{name}.draft")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(draft, self._at(f"{self.path}/{name}")):
            raise OSError(f"{self.path}/{name} could not be published")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)


def checkpointed(spark: SparkSession, df):
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def stored(spark: SparkSession, df):
    """Like :func:`checkpointed`, by columns: a reader takes only those it needs, and the planner knows the size.

    Meant for tables that are read several times. How the rows were dealt out is not kept.
    """
    path = fresh_dir(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df, *by: str):
    """Deal out a table in any case: its rows may all lie in a few of its splits, as those of one row group do.

    Rows with the same values in ``by`` stay together. Meant for work per row that takes many times as
    long as moving the row.
    """
    return df.repartition(max(df.rdd.getNumPartitions(), 2 * df.sparkSession.sparkContext.defaultParallelism), *by)


def spread(df):
    """Deal out a table that has fewer splits than the session has cores.

    Meant before costly work per row. A table with many splits, as on a cluster, is left
    as it is and gets no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
