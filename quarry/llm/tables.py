"""Readers of the input tables and rules that several queries share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(column: str) -> Column:
    """The column of this name, whatever characters the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves 0 when divided by five."""
    return F.coalesce(F.crc32(named(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(batch: pa.RecordBatch, text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `most` bytes of text each, so
    that a task's memory does not follow the size of its batches."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < n:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(sizes.searchsorted(base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def schema_of(df: DataFrame, *kept: str, **added: T.DataType) -> T.StructType:
    """The columns `kept` of df and added ones, as a schema; names may hold anything."""
    return T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in kept), *(T.StructField(c, t) for c, t in added.items())])


def file_place(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs and the columns that tell where each of its rows lies, file and row. Rows
    that do not come straight from files that know it are written down first."""
    for known in (docs, None):
        known = known or materialize(docs, "records")
        try:
            lies = known.metadataColumn("_metadata")
            place = [lies["file_name"], lies["row_index"]]
            _ = known.select(*place).schema
        except AnalysisException:
            continue
        return known, place
    raise ValueError("rows of files whose rows have no numbers")
