"""Structured Streaming: row blocks as they are, groups and keys under a watermark, and sinks batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.functions.values import c, find_field
from weftline.operators.attributes import aggregate_list, parts
from weftline.plans.registry import BlockContext, block_type

#: Blocks that keep state or need all rows; they have forms of their own here or none.
STATEFUL = frozenset(x.lower() for x in ("TransformAggregator", "TransformDeduplicateRecords", "TransformDissolve", "TransformLineMerger", "TransformSpatialEnrich", "TransformDifference", "TransformSnapGeometries", "TransformSpatialFilter"))


def generator_stream(spark: SparkSession, rows_per_second: int = 10, seed: int = 42) -> DataFrame:
    """The data generator without an end: timestamp, id, longitude, latitude."""
    unit = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("value")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select("timestamp", F.col("value").alias("id"), (6.4 + unit(1) * 0.2).alias("longitude"), (52.2 + unit(2) * 0.2).alias("latitude"))


class StreamPipeline:
    """A chain of blocks over a streaming DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = df

    def then(self, block_name: str, **params) -> StreamPipeline:
        """A row-wise block, bound as in a workflow."""
        t = block_type(block_name)
        if block_name.lower() in STATEFUL or t.kind != "transform":
            raise ValueError(f"'{block_name}' has no row-wise form")
        made = t.build(BlockContext(self.df.sparkSession, block_name, {"in": self.df}), **t.bind(params))
        if isinstance(made, dict):
            raise ValueError(f"'{block_name}' has several outputs; use branch")
        return StreamPipeline(made)

    def branch(self, block_name: str, **params) -> dict[str, StreamPipeline]:
        t = block_type(block_name)
        made = t.build(BlockContext(self.df.sparkSession, block_name, {"in": self.df}), **t.bind(params))
        return {port: StreamPipeline(df) for port, df in made.items()}

    def watermark(self, field: str, delay: str) -> StreamPipeline:
        """Rows later than the delay behind the latest time seen may be left out of state."""
        return StreamPipeline(self.df.withWatermark(find_field(self.df.schema, field).name, delay))

    def aggregate(self, group_by: str, aggregates: str, window: str | None = None, time_field: str | None = None, slide: str | None = None) -> StreamPipeline:
        """The aggregator's functions by keys and, if asked, by windows of a time field."""
        keys = [c(find_field(self.df.schema, k).name) for k in parts(group_by)]
        if window:
            keys.insert(0, F.window(c(find_field(self.df.schema, time_field or "").name), window, slide or window).alias("window"))
        made = [(F.count(F.lit(1)) if f == "*" else F.count(c(f)) if fn == "count" else getattr(F, fn)(c(find_field(self.df.schema, f).name).cast("double"))).alias(name) for fn, f, name in aggregate_list(aggregates)]
        return StreamPipeline(self.df.groupBy(*keys).agg(*made))

    def deduplicate(self, key_fields: str) -> StreamPipeline:
        """The first row of each key within the watermark."""
        return StreamPipeline(self.df.dropDuplicatesWithinWatermark([find_field(self.df.schema, k).name for k in parts(key_fields)]))

    def to_sink(self, sink_name: str, checkpoint: str, mode: str = "append", available_now: bool = True, **params) -> StreamingQuery:
        """A workflow sink for every micro-batch; {batch} in its path gives each batch a file of its own."""
        t = block_type(sink_name)

        def write(batch: DataFrame, number: int) -> None:
            bound = {k: v.replace("{batch}", str(number)) if isinstance(v, str) else v for k, v in params.items()}
            t.build(BlockContext(batch.sparkSession, sink_name, {"in": batch}), **t.bind(bound))()

        writer = self.df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
