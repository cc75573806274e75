"""Tables written to the folder that all executors and the driver share.

Lineage is cut with written tables only: they outlive any executor, so a lost
executor costs a re-read and never a recomputation from a vanished copy. A written
table also has a known size, by which joins choose to broadcast it, and filters on
what is made from it are not rewritten through long formulas.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    It is set here only where it is unset and the session runs in one process,
    as tests do; a cluster without the setting is an error, because a folder of
    the driver's machine would be out of the executors' reach.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="regulonspark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/regulonspark/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def session_setting(spark: SparkSession, key: str, value: str):
    """``key`` is ``value`` inside, and what it was before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession):
    """Spark removes the shuffle files of each command run inside as soon as that command has ended.

    Until then they stay, so a task or a stage of a lost executor can run again.
    """
    return session_setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, name: str, *, few: bool = False, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder, with the writer's ``options``, and read again.

    With ``few`` its rows are dealt anew over as few files as their size asks for: for
    results that are small beside the tasks that make them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_dropped(spark):
        (df.hint("rebalance") if few else df).write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` gave, once all that is made from them is itself written."""
    for table in tables:
        _delete(table.sparkSession, table.stored_at)


def release(spark: SparkSession) -> None:
    """Deletes the tables written so far; frames that read them stop working."""
    _delete(spark, f"{shared_dir(spark)}/regulonspark")
