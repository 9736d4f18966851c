"""Session helpers: table access, shared materialisation and task counts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables that cut lineage.

    It is the one ``spark.checkpoint.dir`` names. Only where that is unset, as
    in local tests, a temporary folder of this process takes its place.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="flowskein-")
        _OWN[app] = f"{base.rstrip('/')}/flowskein-{app}"
        atexit.register(_remove_quietly, spark, _OWN[app])
    return _OWN[app]


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        discard(spark, path)
    except Exception:  # the JVM may be gone at exit
        pass


def discard(spark: SparkSession, path: str) -> None:
    """Delete a materialised table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The files outlive any executor and the new plan starts at their scan, so
    iterative operators neither recompute nor carry lineage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table_version(spark: SparkSession, sf_dir: str, name: str) -> str:
    """What tells one state of a table's files from another: their size and time."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{path.toUri()}:{fs.getContentSummary(path).getLength()}:{fs.getFileStatus(path).getModificationTime()}"


_STORED: dict[tuple[str, ...], tuple[DataFrame, str]] = {}


def stored(spark: SparkSession, name: str, versions: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of a session read: written once for each state of what it is made of."""
    key = (spark.sparkContext.applicationId, name, *versions)
    if key not in _STORED:
        _STORED[key] = materialize(build(), name)
    return _STORED[key][0]


class Levels:
    """Rows of a loop, level by level, each level written once.

    Every ``COMPACT`` levels what is there is written as one table, so that the
    plan over all of them stays short however many there are. Plans made of
    ``all()`` before are not to be run after an ``add``.
    """

    COMPACT = 16

    def __init__(self, name: str) -> None:
        self.name = name
        self.parts: list[tuple[DataFrame, str]] = []
        self.last: DataFrame | None = None

    def add(self, level: DataFrame) -> int:
        """Writes a level; returns how many rows it has."""
        self.last, path = materialize(level, f"{self.name}-level")
        if len(self.parts) >= self.COMPACT:  # only now: the new level's plan reads the parts
            whole = materialize(self.all(), f"{self.name}-levels")
            for _, old in self.parts:
                discard(whole[0].sparkSession, old)
            self.parts = [whole]
        self.parts.append((self.last, path))
        return self.last.count()

    def all(self) -> DataFrame:
        out = self.parts[0][0]
        for part, _ in self.parts[1:]:
            out = out.unionByName(part)
        return out


def task_count(spark: SparkSession) -> int:
    """Reduce tasks that the session is set up for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
