"""Helpers shared by the operators: shared-storage tables, broadcasts behind a size check, components."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: With this setting Spark deletes what a query has shuffled when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A side of a join is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 50_000


#: Stands for a null id where pandas would turn a column with nulls into floats.
NO_ID = -(1 << 63)


def id_in(name: str = "doc_id") -> Column:
    """The id column as a long without nulls, for tasks in Python."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias(name)


def id_out(name: str = "doc_id") -> Column:
    """The reverse of id_in()."""
    return F.when(F.col(name) != F.lit(NO_ID), F.col(name)).alias(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Where none is set, a folder of our own if all runs on this machine, else an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="pennant-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
        pass


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """The setting on while any thread of the session is in here; the last one to leave puts back what was set before.

    The lock lies with the session: a module's globals travel with functions that run in tasks, and locks cannot.
    """
    state = spark.__dict__.setdefault("_pennant_writers", {"lock": threading.Lock(), "writers": 0, "before": "false"})
    with state["lock"]:
        if not state["writers"]:
            state["before"] = spark.conf.get(_CLEANUP)
            spark.conf.set(_CLEANUP, "true")
        state["writers"] += 1
    try:
        yield
    finally:
        with state["lock"]:
            state["writers"] -= 1
            if not state["writers"]:
                spark.conf.set(_CLEANUP, state["before"])


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    The table outlives lost executors. It goes when the interpreter ends, or earlier by drop(). What the write has
    shuffled goes when it ends, as its plan is not run again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pennant/{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        # hashes and texts seldom repeat within a page, so dictionaries cost more than they save
        df.write.options(compression="zstd", **{"parquet.enable.dictionary": "false"}).parquet(path)
    atexit.register(_delete_quietly, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pennant_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing will read again."""
    for df in tables:
        path = getattr(df, "_pennant_path", None)
        if path:
            _delete(df.sparkSession, path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if a count proves it has at most `rows` rows, else df itself (then Spark shuffles)."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph of (a long, b long) rows, as (id, component), component the smallest id.

    Every round takes the smallest label among neighbours (a partial aggregation, so hubs are combined before the
    shuffle), then follows labels of labels, so that long chains halve. Labels only fall, so the rounds end. They stay
    in Spark; only whether one changed reaches the driver. Self-links and repeated links are harmless; no rows give no
    rows.
    """
    both = written(
        edges.where("a <> b").selectExpr("inline(array(struct(a as id, b as other), struct(b as id, a as other)))").distinct(),
        "links",
    )
    labels = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "labels")
    while True:
        label_of = labels.select(F.col("id").alias("other"), F.col("component").alias("near"))
        heard = both.join(label_of, "other").groupBy("id").agg(F.min("near").alias("near"))
        met = labels.join(heard, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        far = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        step = met.join(far, "component").select("id", F.least("component", "root").alias("component"), "was")
        new = written(step, "labels")
        changed = not new.where("component <> was").isEmpty()
        drop(labels)
        labels = new.drop("was")
        labels._pennant_path = new._pennant_path
        if not changed:
            drop(both)
            return labels
