"""The folder that the driver and all executors share, and tables that are written there."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and everything runs in one process, a folder of our own."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that all of them see")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def _gone_at_the_end(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps start from these files, which go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _gone_at_the_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, path: str, buckets: int, by: str, order: list[str]) -> DataFrame:
    """``df`` written to ``path`` as a table in buckets of ``by``, sorted within them: what is grouped by it later isn't shuffled."""
    df.write.mode("overwrite").option("path", path).bucketBy(buckets, by).sortBy(*order).saveAsTable(_bucketed_name(path))
    return read_bucketed(df.sparkSession, path)


def _bucketed_name(path: str) -> str:
    return f"bucketed_{hashlib.md5(path.encode(), usedforsecurity=False).hexdigest()}"


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``bucketed`` wrote; another application reads its files without their buckets."""
    name = _bucketed_name(path)
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(path)


def stored_by(df: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
    """As ``stored``, in buckets of ``by``, which ``df`` has as its partitions: a join by it doesn't shuffle the table again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = bucketed(df, path, buckets, by, [by])
    _gone_at_the_end(df.sparkSession, path)
    return out


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, size, time) of the files under ``path``."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True)
    found = []
    while listed.hasNext():
        f = listed.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def version(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files under ``path``: another one when the table was written anew."""
    return hashlib.md5(repr(_files(spark, path)).encode(), usedforsecurity=False).hexdigest()


def parts(spark: SparkSession, path: str, size: int = 8 << 20) -> int:
    """Partitions for a table that is dealt anew: one for every ``size`` bytes of its files and at least one a core, as tasks of a fixed number grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-sum(f[1] for f in _files(spark, path)) // size))


#: What an application has made already, by application and key: the folder.
_MADE: dict[tuple, str] = {}


def made_once(spark: SparkSession, key: tuple, make: Callable[[str], None], source: str | None = None) -> str:
    """The folder of what ``make`` writes, made the first time that an application asks for the key, and again when the table at ``source`` has changed."""
    key = (spark.sparkContext.applicationId, *key, *([version(spark, source)] if source else []))
    if key not in _MADE:
        path = f"{shared_folder(spark)}/{key[1]}-{uuid.uuid4().hex}"
        make(path)
        _gone_at_the_end(spark, path)
        _MADE[key] = path
    return _MADE[key]
