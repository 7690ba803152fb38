"""What the operators share: the folder that all executors see, and the workers' import path."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


#: What Spark allows one Arrow batch of a Python worker by default, and what the operators here allow.
ARROW_DEFAULT, ARROW_BYTES = "67108864b", 1 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package (a cluster gets it by --py-files), and bound the bytes
    of a batch: several copies of one are held at a time, off the JVM's heap and in the worker. A session that has
    set its own bound keeps it."""
    if spark.conf.get(_ARROW) == ARROW_DEFAULT:
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def free_names(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be none of the columns' (case ignored)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def tidy() -> None:
    """In a worker: memory that is no longer used goes back to the system, as the next task may be of another kind."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function of a task's batches that tidies when they are over. Workers are used again: what the tasks of all earlier
    stages once needed would otherwise add to the needs of this one."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return whole


def tidied_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``tidied`` for a function of one group."""

    @functools.wraps(run)
    def whole(table: pa.Table) -> pa.Table:
        out = run(table)
        tidy()
        return out

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a new one on a single machine, and on a cluster an error."""
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Workspace:
    """Tables of one operator call, in the shared folder; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        ready(spark)
        self.spark, self.base, self.tables = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Cut the lineage: a written table is read again by whoever needs it, whatever is lost."""
        path = self.path(table)
        self.tables.append(table)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _fs(self, path: str):
        jvm, p = self.spark._jvm, None
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def size(self, table: str) -> int:
        fs, p = self._fs(self.path(table))
        return fs.getContentSummary(p).getLength()

    def drop(self, *tables: str) -> None:
        for t in tables:
            fs, p = self._fs(self.path(t))
            fs.delete(p, True)

    def keep(self, *tables: str) -> None:
        """Drop all tables but these: those that the operator's result still reads."""
        self.drop(*(t for t in dict.fromkeys(self.tables) if t not in tables))

    def release(self) -> None:
        """Let Spark delete the shuffle files of jobs that are over."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()
