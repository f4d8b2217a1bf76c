"""Resumable work: only what a target table doesn't hold yet is done and appended.

The same step serves a batch and a stream of files; a batch of the stream that
runs again adds nothing, since its rows are in the target by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Step = Callable[[DataFrame], DataFrame]


def missing_rows(df: DataFrame, target: str, key: str) -> DataFrame:
    """Rows, each id once, whose id the target doesn't hold."""
    once = df.dropDuplicates([key])
    try:
        done = df.sparkSession.read.parquet(target).select(key)
    except AnalysisException:
        return once
    return once.join(done, key, "left_anti")


def append_missing(df: DataFrame, target: str, key: str, step: Step = lambda x: x) -> None:
    step(missing_rows(df, target, key)).write.mode("append").parquet(target)


def append_stamped(df: DataFrame, target: str, key: str, stamp: str, step: Step = lambda x: x) -> bool:
    """As ``append_missing``, for a target that was made under the same ``stamp`` (a model's name, the number of rows);
    one under another stamp is made anew.  Returns whether it went on with what was there."""
    spark = df.sparkSession
    rows, mark = f"{target}/rows", f"{target}/stamp"
    try:
        same = [r.stamp for r in spark.read.schema("stamp string").json(mark).collect()] == [stamp]
    except AnalysisException:
        same = False
    if not same:  # the stamp goes first, so that a broken run isn't taken for one under this stamp
        spark.createDataFrame([("",)], "stamp string").coalesce(1).write.mode("overwrite").json(mark)
        step(df.where("false")).write.mode("overwrite").parquet(rows)
        spark.createDataFrame([(stamp,)], "stamp string").coalesce(1).write.mode("overwrite").json(mark)
    append_missing(df, rows, key, step)
    return same


def follow(stream: DataFrame, target: str, key: str, checkpoint: str, step: Step = lambda x: x, once: bool = True) -> StreamingQuery:
    """A file stream whose new rows go through ``step`` to the target."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_missing(df, target, key, step))
    return (writer.trigger(availableNow=True) if once else writer).start()
