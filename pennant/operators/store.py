"""Writing: keep-first appends, keep-last upserts, replaced partitions, text and CSV sinks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pennant.functions.text import sql_quoted


def append_keep_first(target: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """target with the rows of incoming whose key is new, the first by `order`; rows with a null in the key always come in."""
    loose = F.lit(False)
    for c in key:
        loose = loose | F.col(c).isNull()
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    fresh = incoming.where(~loose).withColumn("_k", first).where("_k = 1").drop("_k").join(target.select(*key), key, "left_anti")
    return target.unionByName(fresh.select(target.columns)).unionByName(incoming.where(loose).select(target.columns))


def upsert_keep_last(target: DataFrame, incoming: DataFrame, keys: list[list[str]], order: str) -> DataFrame:
    """target with incoming on top; rows that agree with a later one in any of the unique `keys` go.

    Of incoming, the last by `order` stays for each key in turn.
    """
    last = incoming
    for key in keys:
        last = last.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")
    rest = target
    for key in keys:
        rest = rest.join(last.select(*key), key, "left_anti")
    return rest.select(target.columns).unionByName(last.select(target.columns))


def replace_partitions(rows: DataFrame, path: str, key: list[str], replaced: DataFrame | None = None) -> None:
    """Delete, then insert: the partitions that rows have and those that `replaced` names (columns of key) hold rows afterwards.

    A partition that is named but has no row any more is deleted; others are left as they are. Rows whose partition is
    not named come in all the same. New partitions are in place before stale ones go, so a run that fails in between can
    be repeated.
    """
    spark = rows.sparkSession
    system, target = files_of(spark, path)
    stale = []
    if replaced is not None and system.exists(target):
        rows = settled(rows)  # asked twice
        gone = replaced.select(*key).distinct().join(rows.select(*key).distinct(), key, "left_anti")
        folders = spark.read.parquet(path).select(*key, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).join(F.broadcast(gone), key, "left_semi").select("folder")
        stale = [r["folder"] for r in folders.distinct().collect()]  # one row a partition that goes
    rows.write.partitionBy(*key).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    for folder in stale:
        delete(spark, unquote(folder))


def plain_number(value: Column, digits: int = 6) -> Column:
    """A number rounded to `digits` places as text: no exponent, no zeros at its end but one after the point."""
    text = F.round(value, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(text, r"(\.[0-9]+?)0+$", "$1")


def write_csv(rows: DataFrame, path: str, order: list[str], columns: list[str] | None = None, digits: int = 6) -> None:
    """One CSV file at `path`: a header, the columns as listed, rows sorted by `order`, fractions by plain_number(), null as nothing.

    The file is written beside its place and moved there when it is whole; one that was there is replaced.
    """
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)
    shown = [(plain_number(F.col(c), digits) if kinds[c] in ("double", "float") else F.col(c).cast("string")).alias(c) for c in columns or rows.columns]
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    ordered = rows.orderBy(*order).select(*shown).coalesce(1)  # one file is what is asked for
    ordered.write.csv(beside, header=True, emptyValue="", nullValue="")
    system, folder = files_of(spark, beside)
    part = next(f.getPath() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-"))
    _, target = files_of(spark, path)
    system.delete(target, True)
    if not system.rename(part, target):
        raise OSError(f"{path} could not be written")
    delete(spark, beside)


class Conflict(RuntimeError):
    """Another writer was first; the table is as that one left it."""


class Stored:
    """A table of Parquet folders with versions.

    A version is a file in _log, named by its number, that lists the folders which make up the table. A write first puts
    its rows into a folder of its own, then creates the next number, which only one writer can: until then, and if it
    fails in between, readers have the version before; afterwards all read the new one. Folders of older versions stay
    for readers that still use them, until clean().
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._empty = spark.createDataFrame([], schema)

    def _versions(self) -> list[tuple[int, list[str]]]:
        """Number and folders of every whole version, oldest first."""
        system, log = files_of(self.spark, f"{self.path}/_log")
        if not system.exists(log):
            return []
        found = []
        for file in sorted(f.getPath().getName() for f in system.listStatus(log)):
            text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/_log/{file}").collect())  # a list of folders
            if text.endswith("."):  # else its writer has not finished
                found.append((int(file.removesuffix(".txt")), [line for line in text.split("\n")[:-1] if line]))
        return found

    def version(self) -> int:
        """The number of the current version, 0 if nothing was written."""
        return max((n for n, _ in self._versions()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the current version, or of an older one."""
        folders = next((f for n, f in reversed(self._versions()) if version is None or n == version), [])
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self._empty

    def _switch(self, before: int, folders: list[str]) -> int:
        system, log = files_of(self.spark, f"{self.path}/_log")
        system.mkdirs(log)
        _, entry = files_of(self.spark, f"{self.path}/_log/{before + 1:012d}.txt")
        if system.exists(entry):
            raise Conflict(self.path)
        out = system.create(entry, False)  # fails if another writer was first
        try:
            out.write(bytearray("\n".join([*folders, "."]).encode()))
        finally:
            out.close()
        return before + 1

    def _written(self, rows: DataFrame) -> str:
        folder = f"rows-{uuid.uuid4().hex}"
        rows.select(self._empty.columns).write.parquet(f"{self.path}/{folder}")
        return folder

    def append_keep_first(self, incoming: DataFrame, key: list[str], order: str) -> int:
        """Add the rows whose key is new, see append_keep_first(); the version's number, the same one if there were none.

        Only the key's columns of what is stored are read, and nothing of it is written again.
        """
        versions = self._versions()
        before, folders = versions[-1] if versions else (0, [])
        fresh = append_keep_first(self._empty, incoming.join(self.read(before).select(*key), key, "left_anti") if folders else incoming, key, order)
        fresh = settled(fresh)
        return before if fresh.isEmpty() else self._switch(before, [*folders, self._written(fresh)])

    def upsert_keep_last(self, incoming: DataFrame, keys: list[list[str]], order: str) -> int:
        """Put incoming on top, see upsert_keep_last(); the new version's number. The whole table is written anew."""
        before = self.version()
        return self._switch(before, [self._written(upsert_keep_last(self.read(before), incoming, keys, order))])

    def clean(self, keep: int = 2) -> None:
        """Delete the folders that none of the last `keep` versions lists, those of unfinished writes too, and older versions."""
        versions = self._versions()
        used = {f for _, folders in versions[-keep:] for f in folders}
        system, root = files_of(self.spark, self.path)
        for file in system.listStatus(root):
            if (name := file.getPath().getName()).startswith("rows-") and name not in used:
                delete(self.spark, f"{self.path}/{name}")
        for number, _ in versions[:-keep]:
            delete(self.spark, f"{self.path}/_log/{number:012d}.txt")


def alias_script(matches: DataFrame) -> DataFrame:
    """SQL text (value) that adds the matched aliases."""
    values = F.concat(F.lit("INSERT OR IGNORE INTO team_aliases (alias, team_name) VALUES ("), sql_quoted(F.col("alias")), F.lit(", "), sql_quoted(F.col("team_name")), F.lit(");"))
    return matches.select(values.alias("value"))


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """rows with all fractional columns rounded, as the files of ratings have them."""
    return rows.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

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


def files_of(spark: SparkSession, path: str):
    """The file system of a path and the path as it names it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing if there is none."""
    system, target = files_of(spark, path)
    system.delete(target, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
        pass


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the interpreter ends."""
    path = f"{shared_dir(spark)}/pennant/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_quietly, spark, path)
    return path


def settled(rows: DataFrame) -> DataFrame:
    """rows computed once, for plans that use them several times or would grow too long: a table in the shared folder.

    The table outlives lost executors and goes when the interpreter ends.
    """
    spark = rows.sparkSession
    path = own_path(spark, "settled")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
