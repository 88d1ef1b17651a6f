"""Shared plumbing of the training-data operators: tables, shared scratch space, components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Words of all operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of at most so many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir`` of the session. Where it is unset, a local session gets
    a temporary folder of its own; on a cluster that is an error, since executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="hunkwise-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


#: Paths made since the innermost ``scratch_until_done`` began, if any did.
_MADE: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/hunkwise/{name}-{uuid.uuid4().hex}"
    if _MADE and not keep:
        _MADE[-1].append(path)
    return path


@contextmanager
def scratch_until_done(spark: SparkSession) -> Iterator[None]:
    """Deletes at the end what was written meanwhile, other than to be kept. Nothing lazy that reads it may be left."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, keep: bool = False, small: bool = False, tasks: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and a lost executor loses nothing.

    ``small`` says that ``df`` is much smaller than what it is made of: its rows are dealt anew, so that the number of
    files follows from their size and not from the tasks that made them. ``tasks`` (of ``tasks_for``) is enough for ``df``;
    where a shuffle would be read by more, it is read and written by so many.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, keep)
    if tasks and tasks < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(tasks)
    elif small:
        df = df.hint("rebalance")
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch = path
    return made


def free(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t.scratch)


def free_when_done(made: DataFrame) -> None:
    """A table written to be kept goes with the scratch of the block around, if there is one."""
    if _MADE:
        _MADE[-1].append(made.scratch)


def drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes shuffle files when the driver happens to collect the plans that made them; this has it done now."""
    gc.collect()
    spark._jvm.System.gc()


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_bytes(df: DataFrame) -> Column:
    """About the bytes that a row takes in memory."""

    def of(c: Column, kind: DataType) -> Column | int:
        if isinstance(kind, StringType | BinaryType):
            return 24 + F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(kind, ArrayType):
            inner = kind.elementType
            if isinstance(inner, StringType | BinaryType):
                return 24 + F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + 24 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
            return 24 + (64 if isinstance(inner, StructType) else 8) * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        return 8

    return F.lit(16).cast("long") + sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0))


def total_bytes(df: DataFrame) -> int:
    """About the bytes that all rows take in memory."""
    return df.select(row_bytes(df).alias("n")).agg(F.sum("n")).first()[0] or 0


def tasks_for(df: DataFrame) -> int:
    """Tasks that suffice for what is made of the rows of ``df``, four megabytes for each."""
    return 12 + (total_bytes(df) >> 22)


def is_small(df: DataFrame) -> bool:
    """Whether all rows of ``df`` take at most ``BROADCAST_BYTES``."""
    return total_bytes(df) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcasting if it is small, else ``df`` itself."""
    return F.broadcast(df) if is_small(df) else df


def min_labels(edges: DataFrame, name: str = "labels") -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, root)``, root being the smallest node reachable.

    Nodes are of any ordered type. Rounds of neighbour minima followed by pointer jumping, so long chains take a
    logarithmic number of rounds. Each round ends in a written table, and the tables before it are deleted; only whether a
    row has changed comes to the driver. Labels are broadcast if they are small; the nodes, and so the size, stay.
    """
    both = edges.where("a <> b").select("a", "b")
    tasks = tasks_for(both)
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges", tasks=tasks)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), name, small=True, tasks=tasks)
    fits = is_small(labels)
    held = F.broadcast if fits else lambda t: t
    while True:
        near = both.join(held(labels.select(F.col("node").alias("b"), "root")), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = written(near.join(held(labels), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), name, small=True, tasks=tasks)
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = written(hooked.join(held(jump), "root").select("node", "old", F.least("root", "up").alias("root")), name, small=True, tasks=tasks)
        free(labels, hooked)
        labels = after
        if labels.where("root <> old").isEmpty():
            free(both)
            found = labels.select("node", "root")
            found.scratch = labels.scratch
            return found
        scratch, labels = labels.scratch, labels.select("node", "root")
        labels.scratch = scratch
