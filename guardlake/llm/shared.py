"""Written intermediate tables and small column helpers shared by the operators."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.functions.rows import let, running_starts
from guardlake.spark import shared_folder

__all__ = ["WORD", "drop", "fresh", "in_arrow", "let", "packed", "reads", "running_starts", "scope", "stage", "table", "text_of"]

#: A word everywhere in this package: a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: lineage ends there, lost executors re-read it."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    for paths in _scope:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Paths staged while a scope is open; none is by default.
_scope: list[list[str]] = []


@contextlib.contextmanager
def scope(paths: list[str]):
    """Note in ``paths`` what is staged inside, for a caller that knows when it has been read."""
    _scope.append(paths)
    try:
        yield paths
    finally:
        _scope.pop()


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove staged tables that no later plan reads."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def reads(df: DataFrame, paths: list[str]) -> bool:
    """Whether a table's plan still reads any of the staged paths."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths().mkString("\n")
            if any(p.rsplit("/", 1)[1] in roots for p in paths):
                return True
    return False


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of a table in one struct ``doc``, so that computed names cannot clash with the table's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[v.alias(k) for k, v in more.items()])


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def in_arrow(rows: DataFrame, run, schema: str, batch: int = 1000) -> DataFrame:
    """``mapInArrow`` over slices of at most so many rows, since texts can be long. The session's settings stay as they are."""
    def sliced(batches):
        return run(part.slice(at, batch) for part in batches for at in range(0, part.num_rows, batch))

    return rows.mapInArrow(sliced, schema)
