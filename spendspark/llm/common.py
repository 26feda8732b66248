"""What the corpus operators share: reading, cutting lineage, names, Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendspark.store import shared_folder, written

__all__ = ["arrow_columns", "numbered", "quoted", "shared_folder", "small_enough", "table", "unused", "without", "written"]

#: Broadcasts are hinted only below so many estimated bytes.
BROADCAST_BYTES = 8 << 20
#: Rows whose values are Python objects at the same time; an Arrow batch may hold many times as many.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name``; any file system that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit BROADCAST_BYTES, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``df`` but for ``names``, whatever their case: an operator's outputs replace columns of the same name."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has it already, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with names of its own for all columns, in order, and the new names by the old ones and by their lower case."""
    names = [f"d{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(map(str.lower, df.columns), names)) | dict(zip(df.columns, names))


def arrow_columns(df: DataFrame, source: str, fields: list[T.StructField], start: Callable[[], Callable[[list], list[list]]], keep_source: bool = True) -> DataFrame:
    """Adds ``fields``, computed from column ``source`` in Arrow batches.

    Each column is sent once, ``source`` as well, as batches of long texts fill an executor outside its heap; without
    ``keep_source`` it isn't sent back.

    ``start`` runs once a task and returns a function from a batch's values to a list of columns. Nothing outlives the task,
    so a lost executor costs only its tasks. Other columns pass through; those named like an output are replaced.
    """
    kept = without(df, [*[f.name for f in fields], *([] if keep_source else [source])])
    sent = kept if source in kept else [*kept, source]
    at_source = sent.index(source)
    # Under names of its own, so that no caller's name (dots, backticks) matters to the function.
    inputs = df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(sent)])
    schema = T.StructType(inputs.schema.fields[: len(kept)] + [T.StructField(f"r{i}", f.dataType, f.nullable) for i, f in enumerate(fields)])
    kinds = [_arrow(f.dataType) for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = start()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                columns = run(batch.column(at_source).to_pylist())
                arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        # Workers are used again by later tasks: what this one held goes back.
        pa.default_memory_pool().release_unused()

    return inputs.mapInArrow(work, schema).toDF(*kept, *[f.name for f in fields])


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
