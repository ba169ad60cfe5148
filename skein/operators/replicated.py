"""Relational views of a replicated command log: what is committed, what it adds up to, whether nodes agree.

Consensus itself is no query, and a Spark job does not need it; its rules can be checked on tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.versions import visible_at


def commit_index(match: DataFrame, log: DataFrame, term: int) -> DataFrame:
    """One row `(commit_index)`: the largest index that a quorum has and whose entry is of the current term, else 0.

    `match(node, match_index)` has every member, the leader included; `log(index, term)` is the leader's log.
    """
    reached = log.where(F.col("term") == term).join(F.broadcast(match.agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m"))))
    quorum = F.element_at("m", F.floor(F.size("m") / 2).cast("int") + 1)
    return reached.where(F.col("index") <= quorum).agg(F.coalesce(F.max("index"), F.lit(0)).cast("long").alias("commit_index"))


def grants(requests: DataFrame) -> DataFrame:
    """Requests for a vote with `granted`: not of an older term, no other vote in that term, and a log at least as up
    to date (by last term, then last index). Columns: term, candidate, last_term, last_index of the request;
    my_term, voted_for, my_last_term, my_last_index of the voter."""
    free = (F.col("term") > F.col("my_term")) | F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate"))
    fresh = (F.col("last_term") > F.col("my_last_term")) | ((F.col("last_term") == F.col("my_last_term")) & (F.col("last_index") >= F.col("my_last_index")))
    return requests.withColumn("granted", (F.col("term") >= F.col("my_term")) & free & fresh)


def fold(commands: DataFrame) -> DataFrame:
    """The state that a log of commands `(id, seq, op, ...)` leaves, up to any length: the last put of each id that no
    delete follows. Commands that are neither (noop) change nothing."""
    return visible_at(commands.where(F.col("op").isin("put", "delete")))


def convergence(logs: DataFrame) -> DataFrame:
    """One row `(nodes, logs, converged)` of `logs(node, index, term, command)`: nodes converge if their logs are equal.
    Each node's log is summed up by hashes of its entries, not gathered."""
    entry = F.xxhash64("index", "term", "command").cast("decimal(38,0)")
    each = logs.groupBy("node").agg(F.count("*").alias("n"), F.sum(entry).alias("h"), F.max("index").alias("last"))
    return each.agg(F.count("*").alias("nodes"), F.count_distinct("n", "h", "last").alias("logs")).select("nodes", "logs", (F.col("logs") <= 1).alias("converged"))


def agreement(logs: DataFrame) -> DataFrame:
    """`(index, nodes, terms)` per index: how many nodes have an entry there, and of how many terms. Logs match up to
    the first index with more than one."""
    return logs.groupBy("index").agg(F.count_distinct("node").alias("nodes"), F.count_distinct("term").alias("terms"))
