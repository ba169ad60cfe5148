"""An append-only log of document versions, and what can be read from it.

A log row is `(id, seq, op, ...)`: op is put or delete, seq grows with every commit and is unique per id. A version is
visible at a sequence number s if born <= s < dead, where dead is the seq of the id's next row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: `dead` of a version that nothing has replaced.
INF = 1 << 62


def intervals(log: DataFrame) -> DataFrame:
    """The log with `born` and `dead` of every row, deletions included."""
    following = F.lead("seq").over(Window.partitionBy("id").orderBy("seq"))
    return log.withColumn("born", F.col("seq")).withColumn("dead", F.coalesce(following, F.lit(INF)))


def visible_at(log: DataFrame, seq: int | None = None) -> DataFrame:
    """The put rows that are visible at `seq` (None: now): of each id the last row up to then, unless it is a delete.
    Partitions drop older rows before the shuffle."""
    rows = log if seq is None else log.where(F.col("seq") <= seq)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("seq").desc()))
    return rows.withColumn("_r", place).where("_r = 1").drop("_r").where("op = 'put'")


def latest(log: DataFrame) -> DataFrame:
    """What a compaction keeps if no older state is needed: the last row of each id that isn't deleted."""
    return visible_at(log)


def horizon(open_snapshots: list[int], current: int) -> int:
    """The oldest sequence number that someone may still read."""
    return min([*open_snapshots, current])


def is_garbage(upto: int) -> Column:
    """Rows with intervals that no read at `upto` or later needs: replaced by then, or deletions by then."""
    return (F.col("dead") <= upto) | ((F.col("op") == "delete") & (F.col("born") <= upto))


def vacuum_candidates(log: DataFrame, upto: int) -> DataFrame:
    """The versions that a vacuum removes: put rows with dead <= `upto`."""
    return intervals(log).where((F.col("op") == "put") & (F.col("dead") <= upto))


def retained(log: DataFrame, upto: int) -> DataFrame:
    """The log without what a vacuum at `upto` removes."""
    found = intervals(log)
    return found.where(~is_garbage(upto)).drop("born", "dead")


def conflicts(log: DataFrame, touched: DataFrame, start: int) -> DataFrame:
    """The ids of `touched` that were written, deletions included, after `start`: `(id, seq)` of the last such row."""
    newer = log.where(F.col("seq") > start).groupBy("id").agg(F.max("seq").alias("seq"))
    return newer.join(touched.select("id").distinct(), "id", "left_semi")


def store_stats(log: DataFrame) -> DataFrame:
    """One row: live and deleted ids, versions (put rows), rows of the log, the least and the greatest seq."""
    last = log.groupBy("id").agg(F.max_by("op", "seq").alias("op"), F.count_if(F.col("op") == "put").alias("puts"), F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    return last.agg(
        F.count_if(F.col("op") == "put").alias("live"),
        F.count_if(F.col("op") == "delete").alias("tombstones"),
        F.coalesce(F.sum("puts"), F.lit(0)).cast("long").alias("versions"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("log_rows"),
        F.coalesce(F.min("low"), F.lit(0)).alias("min_seq"),
        F.coalesce(F.max("high"), F.lit(0)).alias("max_seq"),
    )
