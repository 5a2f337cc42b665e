"""Helpers shared by the operators: Arrow columns beside a frame's own, stored intermediate tables, places in an order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenaflow.session import scratch_path

SLICE_BYTES = 4 << 20
#: Spark's setting that shuffle files of a query are deleted when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def slices(batch: pa.RecordBatch, text: str | None, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``limit`` bytes of ``text``: what a task holds is bounded by bytes."""
    if text is None or batch.num_rows < 2:
        yield batch
        return
    column = batch.column(batch.schema.get_field_index(text))
    size = max(1, int(limit / max(1.0, column.nbytes / batch.num_rows)))
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def with_columns(
    frame: DataFrame, fields: Sequence[T.StructField],
    start: Callable[[], Callable[[pa.RecordBatch], Sequence]], text: str | None = None,
) -> DataFrame:
    """Append columns computed from Arrow batches.

    ``start()`` runs once in a task and returns a function from a batch to one
    array (or list) for each field.  A column of the frame whose name clashes
    with a new one gives way to it; all others pass through.
    """
    taken = {field.name.lower() for field in fields}
    kept = [name for name in frame.columns if name.lower() not in taken]
    schema = T.StructType([frame.schema[name] for name in kept] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        make = start()
        for whole in batches:
            for batch in slices(whole, text):
                made = make(batch)
                arrays = [batch.column(batch.schema.get_field_index(name)) for name in kept]
                for value, field in zip(made, list(target)[len(kept):], strict=True):
                    arrays.append(value if isinstance(value, pa.Array) else pa.array(value, field.type))
                yield pa.RecordBatch.from_arrays(
                    [array.cast(field.type) for array, field in zip(arrays, target, strict=True)], schema=target)

    return frame.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [value or "" for value in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def stored(frame: DataFrame, label: str, partition: str | None = None) -> DataFrame:
    """Write a frame below the shared checkpoint folder and read it again: its lineage and its shuffle files end there."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    writer = frame.write
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        (writer.partitionBy(partition) if partition else writer).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)
    return spark.read.schema(frame.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(frame: DataFrame, order: Sequence[str]) -> DataFrame:
    """Give rows their place in their tree by ``order`` (nulls first) as ``number``, and its size as ``count``.

    Rows are ordered in ranges; only one count for each range and tree meets others.
    """
    columns = ["tree", *order]
    ranged = frame.repartitionByRange(partitions(frame.sparkSession), *columns).sortWithinPartitions(*columns)
    schema = ranged.withColumns({"part": F.spark_partition_id(), "at": F.lit(0).cast("long")})

    def count(batches):
        last, at = None, 0
        for batch in batches:
            places = []
            for tree in batch.column(0).to_pylist():
                at = at + 1 if tree == last else 0
                last = tree
                places.append(at)
            yield batch.append_column("at", pa.array(places, pa.int64()))

    first = ranged.withColumn("part", F.spark_partition_id()).select(
        "tree", *[name for name in frame.columns if name != "tree"], "part")
    placed = stored(first.mapInArrow(count, schema.select(*first.columns, "at").schema), "placed-rows")
    sizes = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("size"))
    running = sizes.selectExpr(
        "tree", "part", "sum(size) OVER (PARTITION BY tree ORDER BY part) - size AS before",
        "sum(size) OVER (PARTITION BY tree) AS count")
    return placed.join(running, ["tree", "part"]).withColumn("number", F.col("before") + F.col("at")).drop(
        "part", "at", "before")
