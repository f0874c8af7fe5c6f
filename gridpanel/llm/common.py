"""What the training-data operators share: the tables, the shared folder, cutting lineage."""

from __future__ import annotations

import contextlib
import functools
import re
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset and the master is local (tests on one machine) a
    temporary folder is made and set as the checkpoint folder of the context. On a
    cluster a folder of the driver is seen by no executor, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gridpanel-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Texts go to Python workers in batches of so many bytes at most, which bounds what executor and worker hold.

    The setting is the session's and stays, since frames run after they are made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and no executor holds the only copy."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gp_path = path
    for made in _PASSING:
        made.append(out)
    return out


_PASSING: list[list[DataFrame]] = []


@contextlib.contextmanager
def passing():
    """What cut() writes within is deleted at the end, but for the frames given to the function that this yields."""
    made: list[DataFrame] = []
    held: list[DataFrame] = []
    _PASSING.append(made)
    try:
        yield lambda df: held.append(df) or df
    finally:
        _PASSING[:] = [m for m in _PASSING if m is not made]
        for df in made:
            if not any(df is h for h in held):
                discard(df)


def own_name(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with underscores put before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def guarded(operator):
    """An operator on a first frame that may have columns whose names begin with two underscores, as internal ones do: these are called otherwise meanwhile."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        other = {c: f"other{i}_{c}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        if not other:
            return operator(docs, *args, **kwargs)
        out = operator(docs.withColumnsRenamed(other), *args, **kwargs)
        return out.withColumnsRenamed({v: k for k, v in other.items()})

    return run


def free_names(docs: DataFrame, added: tuple[str, ...]) -> None:
    """An error if docs has a column that would be added."""
    if clash := {c.lower() for c in added} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns are there already: {', '.join(sorted(clash))}")


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which some may hold a large share of left's rows, where right is an aggregate by the same keys.

    Joined on the keys alone, right would keep the partitioning of its aggregate,
    and adaptive execution couldn't split a hot key's rows. A hash of the keys as a
    further key makes Spark shuffle both sides for the join, which it can split.
    """
    mark = F.xxhash64(*keys)
    return left.withColumn("__hot", mark).join(right.withColumn("__hot", mark), [*keys, "__hot"], how).drop("__hot")


def discard(df: DataFrame) -> None:
    """Delete what cut() wrote for df; call it only when nothing reads df any more."""
    path = getattr(df, "_gp_path", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def kept(kind: str, key: str, make):
    """What a worker process made last for this kind, if it was made for the same key; so tasks of one worker share it."""
    store = sys.modules.setdefault("_gridpanel_kept", types.ModuleType("_gridpanel_kept"))
    if getattr(store, kind, (None,))[0] != key:
        setattr(store, kind, (key, make()))
    return getattr(store, kind)[1]
