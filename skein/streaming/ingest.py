"""Incremental ingest: new files only, exactly once, with carried state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, glob: str = "*.parquet") -> None:
    """Appends the rows of files not seen before to ``target``; the stream's checkpoint is the resume set."""
    s = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(source)
    q = s.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def carried_regions(stream: DataFrame, key: str, order: str, surface: str) -> DataFrame:
    """(key, order, surface, region_no): running region numbers of each journey, carried between batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(stream.dtypes)
    out = f"{key} {kind[key]}, {order} {kind[order]}, {surface} string, region_no long"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        no, last = state.get if state.exists else (0, None)
        pdf = pd.concat(list(batches)).sort_values(order)
        numbers = []
        for x in pdf[surface]:
            if x != last or no == 0:
                no, last = no + 1, x
            numbers.append(no)
        state.update((no, last))
        yield pd.DataFrame({key: k[0], order: pdf[order], surface: pdf[surface], "region_no": numbers})

    return stream.groupBy(key).applyInPandasWithState(step, out, "no long, last string", "append", GroupStateTimeout.NoTimeout)
