"""Session helpers: cutting lineage, shared scratch folders, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a narrow side is broadcast; beyond it the join is left to shuffle.
BROADCAST_ROWS = 1_000_000
#: And about the bytes up to which it is.
BROADCAST_BYTES = 128 << 20
#: Rows of a task where a step is split by its number of rows.
TASK_ROWS = 250_000
#: Pairs that a task makes where they are streamed on.
TASK_PAIRS = 4_000_000
#: Rows of an Arrow batch to or from Python.
ARROW_ROWS = 1500
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and the session
    runs in this one machine; elsewhere a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rsplit("/", 1)[0]
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = tempfile.mkdtemp(prefix="tidewake-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(f"file://{own}/cp")
    return f"file://{own}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder at once and continue from the files."""
    spark = df.sparkSession
    path = shared_dir(spark)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    local = path.removeprefix("file://")
    if local.startswith("/"):
        os.makedirs(local, exist_ok=True)
        atexit.register(shutil.rmtree, local, True)
    return path


def row_bytes(schema: T.StructType) -> int:
    """About the bytes of a row: what the optimizer supposes of each type, more of strings and arrays."""
    def of(kind):
        if isinstance(kind, T.StructType):
            return sum(of(f.dataType) for f in kind)
        if isinstance(kind, T.ArrayType | T.MapType):
            return 32 * (of(kind.elementType) if isinstance(kind, T.ArrayType) else of(kind.keyType) + of(kind.valueType))
        return 64 if isinstance(kind, T.StringType | T.BinaryType) else 8

    return 8 + of(schema)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows and about so many bytes, else unchanged."""
    most = max(1, min(rows, size // row_bytes(df.schema)))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, rows: int, *keys, each: int = TASK_ROWS) -> DataFrame:
    """df shuffled by keys (or evenly, without any) into parts of about `each` of those rows, as many as the session's at least.

    Parts asked for so aren't joined again by the session, so a task's share doesn't grow with the input.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // each)), *keys)


def range_sorted(df: DataFrame, *order, names: tuple[str, str] = ("tw_part", "tw_pos")) -> DataFrame:
    """df with the part of a range sort that a row is in, and its position over all, from 1.

    Parts are numbered in order; their sizes are added up, a row a part, so no task has all rows.
    """
    part, pos = names
    s = cut(df.orderBy(*order).withColumn(part, F.spark_partition_id()))
    local = s.withColumn(pos, F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("long"))
    sizes = s.groupBy(part).agg(F.count("*").alias("n"))
    ahead = sizes.select(F.col(part).alias("tw_of"), F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("tw_ahead"))
    return local.join(small(ahead), F.col(part) == F.col("tw_of")).withColumn(pos, F.col(pos) + F.col("tw_ahead")).drop("tw_of", "tw_ahead")


def in_order(df: DataFrame, key: str, order: list, fn, schema) -> DataFrame:
    """fn over the rows of each key in order, as a stream of Arrow batches.

    A key's rows come one after another in one task, sorted by Spark (which spills), so a
    key of any size takes no more memory than a batch and what fn remembers.
    """
    return arrow(df.repartition(key).sortWithinPartitions(key, *order), fn, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have yet, whatever the case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidewake-code-")
    atexit.register(shutil.rmtree, folder, True)
    target = f"{folder}/tidewake_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for base, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.join("tidewake", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._tidewake_shipped = True


def arrow(df: DataFrame, fn, schema) -> DataFrame:
    """df.mapInArrow(fn, schema) with this package at hand in the workers.

    Arrow batches are kept to ARROW_ROWS rows unless the session says otherwise, since
    both ends of the pipe hold a batch of whole texts. Spark reads that setting when a
    result is planned, which is after this function has ended, so it stays in the session.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(ARROW_ROWS))
    return df.mapInArrow(fn, schema)
