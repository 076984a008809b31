"""Running network measures over streams of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_strength(edges: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(start, node, strength, degree) by window of a stream or table of edges (i, j, score, time); rows later than late go."""
    d = edges.withWatermark(time, late).select(F.col(time), F.explode(F.array("i", "j")).alias("node"), "score")
    d = d.groupBy(F.window(time, window).alias("w"), "node").agg(F.sum("score").alias("strength"), F.count("*").alias("degree"))
    return d.select(F.col("w.start").alias("start"), "node", "strength", "degree")


def run_to_end(stream: DataFrame, path: str, state: str) -> DataFrame:
    """The whole result of an aggregated stream after all that is there now, written to path as often as it changes.

    state keeps the stream's progress, so a run that is ended goes on where it was.
    """
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
