"""What several corpus operators share: shared storage, word rules, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of characters that are neither a space nor \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. Where none is named, a local one is chosen if the
    session is local (tests); on a cluster that is an error, as executors could not read each other's files."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"skein-{uuid.uuid4().hex}")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """`df`, computed once and cut from its lineage; the copy lies in the shared folder, so it outlives an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def forget(df: DataFrame) -> None:
    """Deletes the copy that `saved` made of `df`, which nothing may read any more."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *by: str, rows: int = 100_000) -> DataFrame:
    """A saved `df` over more partitions, for work that is heavy a row: about `rows` rows in each, and no fewer than a
    shuffle makes."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows + 1)
    return df.repartition(parts, *by)


#: Rows of an Arrow batch at most: texts may be long, and a batch is in memory several times.
ARROW_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ARROW_ROWS rows; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on and runs tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(name: str, taken: list[str]) -> str:
    """`name`, longer by underscores if a column is already called so (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


#: A table of up to so many rows and bytes may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of `df` takes."""
    total = F.lit(16)
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            size = 8 * F.size(c)
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            size = F.octet_length(F.to_json(F.struct(c)))
        else:
            size = F.lit(8)
        total = total + F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)) + 8
    return total.cast("long")


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows of `most` bytes together, which are counted; else as it
    is, to be shuffled."""
    n, total = df.select(row_bytes(df).alias("b")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= most else df


def usable_labels(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """`(_d, _y)`, one row an id, of the ids that have one label and that one 0 or 1. Null ids, other labels and ids
    with both labels are left out."""
    known = labels.select(F.col(doc_id).alias("_d"), F.col(label).cast("int").alias("_y")).where("_d IS NOT NULL AND _y IN (0, 1)")
    return known.groupBy("_d").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").select("_d", "_y")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with `value` computed once a row, however often `then` names it and wherever the optimizer moves
    the expression; inside a lambda an inlined value would else be computed for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


#: A node with more neighbours than this is a hub: its edges are joined where they are, not brought together.
HUB = 500


def _lowest(edges: DataFrame) -> DataFrame:
    """`(v, m)` of edges (u, v): m is the smallest neighbour of u that is smaller, or u. Hubs, of which there are at
    most edges / HUB, are broadcast (if that is few); so a hub's edges don't all land in one task."""
    low = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    hubs = saved(low.where(F.col("n") > HUB).select("u", "m"))
    if hubs.isEmpty():
        return edges.join(low.select("u", "m"), "u")
    wide = sized(hubs)
    rest = edges.join(wide.select("u"), "u", "left_anti")
    light = rest.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return rest.join(light, "u").unionByName(edges.join(wide, "u"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph `edges(a, b)`: one row `(node, root)` per node that has an edge.

    `root` is the smallest node of the component. Alternates large-star and small-star steps, so the number of
    rounds grows with the logarithm of a component's size, not with its diameter; each step is a partially
    aggregated minimum and a join, and no node's neighbours are ever gathered in one place. Self-loops and repeated
    edges change nothing; null ends are ignored; no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = saved(e.where(F.col("a").isNotNull() & F.col("b").isNotNull()).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = saved(large.distinct())
        # Each neighbour, and the node itself, links to the smallest neighbour.
        found = _lowest(large)
        small = found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(found.select("u", F.col("m").alias("v")))
        now_e = saved(small.distinct())
        forget(e), forget(large)
        e = now_e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
