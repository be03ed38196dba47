"""Synthetic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.values import ORD
from weftline.plans.registry import BlockContext, block


@block("SourceDataGenerator", "source")
def data_generator(ctx: BlockContext, maxRows: int = 100_000, batchSize: int = 4096, rowsPerSecond: int = 0, seed: int = 42) -> DataFrame:
    """id 0..maxRows-1 with a longitude in [6.4, 6.6) and a latitude in [52.2, 52.4).

    The numbers depend on seed and id alone, so a lost partition comes back equal. rowsPerSecond sets the pace of the
    streaming form; a batch has none.
    """
    unit = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    rows = ctx.spark.range(max(0, maxRows))
    return rows.select("id", (6.4 + unit(1) * 0.2).alias("longitude"), (52.2 + unit(2) * 0.2).alias("latitude"), F.col("id").alias(ORD))


@block("SourceTable", "source")
def table(ctx: BlockContext, path: str, format: str = "parquet") -> DataFrame:
    """A table in a format of Spark's own; nulls stay nulls."""
    return ctx.spark.read.format(format).load(path)
