"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tabtwin.session import scratch_path

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder.

    Cuts lineage in a form that survives lost executors; compressed columns take far less
    disk than a checkpoint of serialised rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no name can clash with an operator's own."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def unpacked(df: DataFrame, row: str, columns: list[str], added: dict[str, Column]) -> DataFrame:
    """The columns packed in ``row``; ``added`` follows and replaces columns of the same name."""
    taken = {c.lower() for c in added}
    kept = [F.col(row).getField(c).alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(name) for name, c in added.items()])


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` characters or values in ``column`` each; a longer row is a part of its own."""
    values = batch.column(column)
    lengths = pc.fill_null(pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    parts = np.cumsum(lengths, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def with_arrow_column(df: DataFrame, name: str, kind: str, source: str | list[str], keep_source: bool, values: Callable[..., pa.Array]) -> DataFrame:
    """``df`` with a column made in Arrow batches from one or several columns; a column of that name is replaced.

    ``values`` gets the source columns of a part of a batch, cut by the first one's length.
    """
    sources = [source] if isinstance(source, str) else source
    others = [c for c in df.columns if c.lower() != name.lower() and (keep_source or c not in sources)]
    # A source that stays goes to Python once and comes back as it is.
    place = {c: f"source{i}" for i, c in enumerate(sources) if c in others}
    inner = df.select(F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)) for c in others if c not in place]).alias("row"), *[F.col(quoted(c)).alias(f"source{i}") for i, c in enumerate(sources)])
    kept = ["row", *place.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "source0"):
                made = values(*[part.column(f"source{i}") for i in range(len(sources))])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], made], names=[*kept, "value"])
            batch = part = made = None              # let go before the next one is read

    made = StructType([*[inner.schema[c] for c in kept], StructField("value", DataType.fromDDL(kind))])
    return inner.mapInArrow(run, made).select(*[F.col(place[c]).alias(c) if c in place else F.col("row").getField(c).alias(c) for c in others], F.col("value").alias(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
