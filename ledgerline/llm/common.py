"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.staging import written

__all__ = ["free_name", "map_rows", "read", "ship_code", "sized", "slices", "text_or_empty", "to_arrow", "written"]

#: Rows that Python takes from an Arrow batch at a time; texts may be very long.
BATCH_ROWS = 256
#: Tables of ids and hashes are broadcast up to this many rows (some 50 MB), and shuffled beyond it.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once a Spark context: their Python may not have it."""
    context = spark.sparkContext
    if getattr(context, "_ledgerline_shipped", None):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ledgerline-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._ledgerline_shipped = True


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows. Spark bounds a batch by its bytes (spark.sql.execution.arrow.maxBytesPerBatch);
    what Python makes of it is bounded by the part."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) to be broadcast if it has so few rows, and else to be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if need be, so that it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(
    df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., tuple[list, ...]]]
) -> DataFrame:
    """Send ``columns`` to Python in Arrow batches. ``make()`` runs once a task and returns a
    function from the columns' lists to the lists of the output columns."""
    ship_code(df.sparkSession)
    arrow_schema = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in slices(batches):
            out = f(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t.type) for x, t in zip(out, arrow_schema, strict=True)], schema=arrow_schema
            )

    return df.select(*columns).mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    kinds = {
        "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
        "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
        "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<boolean>": pa.list_(pa.bool_()),
        "array<binary>": pa.list_(pa.binary()),
    }
    return pa.schema([(n, kinds[t]) for n, t in (part.strip().rsplit(" ", 1) for part in schema.split(","))])


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
