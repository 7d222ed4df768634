"""Column handling shared by the operators: chosen columns under fixed names, rows fed through Arrow batches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_SHIPPED: set[str] = set()

# Rows of one emitted Arrow batch are held back until they have about this many bytes.
BATCH_BYTES = 8 << 20


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(rows: DataFrame, base: str) -> str:
    """A column name that the table does not have."""
    taken, name = {c.lower() for c in rows.columns}, f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(rows: DataFrame, key: str, **texts: str) -> DataFrame:
    """``key`` and the named text columns only, texts as strings with null as empty.

    Every other column is left behind here, so a clashing name in the input cannot
    meet a name the operator makes.
    """
    return rows.select(
        column(key).alias("key"),
        *[F.coalesce(column(source).cast("string"), F.lit("")).alias(name) for name, source in texts.items()],
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the workers: once per application, unless PYTHONPATH has it already.

    By reference, workers keep their word tables from task to task.
    """
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, app = os.path.dirname(package), spark.sparkContext.applicationId
    if app in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="fairlead-code-"), "fairlead.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def map_batches(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    ship_package(rows.sparkSession)
    return rows.mapInArrow(function, schema)


def per_row(
    rows: DataFrame, work: Callable[[], Callable[..., Iterable[tuple]]], schema: T.StructType, size: Callable[[tuple], int] | None = None
) -> DataFrame:
    """Apply a Python function to each row and emit any number of rows of ``schema``.

    ``work`` runs once per task and returns the function; it gets the row's values as
    positional arguments.  A row yields its results lazily and a batch is sent as soon
    as it is full, so neither a long text nor a long task gathers its whole output.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function, out, held = work(), [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                for values in zip(*(c.to_pylist() for c in part.columns)):
                    for row in function(*values):
                        out.append(row)
                        held += 64 + (size(row) if size else 0)
                        if held >= BATCH_BYTES:
                            yield _record_batch(out, arrow)
                            out, held = [], 0
        if out:
            yield _record_batch(out, arrow)

    return map_batches(rows, run, schema)


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(zip(*rows), schema)], schema=schema
    )


def field(name: str, kind: T.DataType | str) -> T.StructField:
    return T.StructField(name, kind if isinstance(kind, T.DataType) else T._parse_datatype_string(kind))


def key_type(rows: DataFrame) -> T.DataType:
    return rows.schema["key"].dataType
