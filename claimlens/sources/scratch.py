"""Tables on the way, in the folder that a cluster shares.

Lineage is cut by writing a table and reading it back: its files outlive a lost executor, and plans
beyond it read what they need of it instead of computing it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that `written` has made in the scopes of `intermediates` that are open.
_scopes: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a local one for a local master;
    on a cluster, where executors don't share one, ValueError."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with the scope of `intermediates` around."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written to the shared folder and read back with the same schema, and its folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back; nondeterministic columns are fixed from here on.

    The files stay for as long as a result may be read from them: until the scope of `intermediates`
    around ends.
    """
    return stored(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """A scope whose tables of `written` are removed at its end, for callers that store the result inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)
