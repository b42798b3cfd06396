"""Tables written between jobs, in the folder that driver and executors share.

A written table cuts lineage: a lost executor costs the rows it was computing, not the
stages before them.  The folder is the one named by ``spark.checkpoint.dir``, else the
checkpoint folder of the SparkContext.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


class _Own(threading.local):
    """Paths of the tables that this thread has written and not removed, in their order: runs in other threads are not touched."""

    def __init__(self) -> None:
        self.written: list[str] = []


_own = _Own()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder; a local one only where the session names none and has no other machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    _own.written.append(f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _own.written[-1]


def materialize(df: DataFrame, label: str, codec: str = "snappy", **options: int | str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder, with further ``options`` of the writer, and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Where the tables that this thread writes from now on begin, for ``discard``."""
    return len(_own.written)


def discard(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Remove the tables that this thread has written since a mark, but those whose label is in ``keep``: a result still to be computed reads them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _own.written[since:]:
        if path.rsplit("/", 1)[1].rsplit("-", 1)[0] not in keep:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            _own.written.remove(path)
