"""A table that grows batch by batch, read as one running total and the newest parts.

Every MERGE batches the total and the parts since are combined into a new total that names the last batch in it. A replayed
batch overwrites its own part and sees what was there before it; so the total and parts before the last merge stay until the
next one, and no more than that: their number is bounded whatever the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MERGE = 64


def _children(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the complete folders ``name=N`` below ``folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [(s.getPath().getName(), s.getPath()) for s in files.listStatus(path)]
    there = lambda p: files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(n.split("=")[1]) for n, p in found if n.startswith(f"{name}=") and there(p))


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Parts:
    """Parts below ``folder``. ``combine`` turns rows of totals and parts into a total; ``by`` are columns that a total is laid out by."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, combine: Callable[[DataFrame], DataFrame], by: list[str] | None = None, merge: int | None = None):
        self.spark, self.folder, self.combine, self.by, self.merge = spark, folder, combine, by or [], merge or MERGE
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def read(self, before: int) -> DataFrame:
        """All rows of batches before number ``before``: the newest total, and parts since."""
        last = max((n for n in _children(self.spark, f"{self.folder}/totals", "upto") if n < before), default=None)
        newer = [n for n in _children(self.spark, f"{self.folder}/parts", "batch") if n < before and (last is None or n > last)]
        read = self.spark.read.schema(self.schema)
        out = self.spark.createDataFrame([], self.schema) if last is None else read.parquet(f"{self.folder}/totals/upto={last}")
        if newer:
            out = out.unionByName(read.parquet(*[f"{self.folder}/parts/batch={n}" for n in newer]))
        return out.select(*self.schema.names)

    def put(self, rows: DataFrame, number: int) -> None:
        """Writes a batch's part, and where it is time a new total; drops what the total before the last has made needless."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/parts/batch={number}")
        totals = [n for n in _children(self.spark, f"{self.folder}/totals", "upto") if n < number]
        since = [n for n in _children(self.spark, f"{self.folder}/parts", "batch") if n <= number and (not totals or n > totals[-1])]
        if len(since) < self.merge:
            return
        self.combine(self.read(number + 1)).select(*self.schema.names).write.partitionBy(*self.by).mode("overwrite").parquet(f"{self.folder}/totals/upto={number}")
        for n in totals[:-1]:
            _removed(self.spark, f"{self.folder}/totals/upto={n}")
        for n in _children(self.spark, f"{self.folder}/parts", "batch"):
            if totals and n <= totals[-1]:
                _removed(self.spark, f"{self.folder}/parts/batch={n}")


def only_last(spark: SparkSession, folder: str, number: int, keep: int = 2) -> None:
    """Drops all but the last ``keep`` published batches up to ``number``."""
    for n in [n for n in _children(spark, folder, "batch") if n <= number][:-keep]:
        _removed(spark, f"{folder}/batch={n}")
