"""What the operators of this package share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ostra.session import bound_batches, ship, spread

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, split for Python workers of modest memory.

    The session's bounds of Arrow batches are lowered to the package's, never raised.
    """
    ship(spark)
    bound_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, nothing for null."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()
