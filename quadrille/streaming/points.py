"""Points that arrive as a stream: counts per patch, and refinement that follows them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.morton import MortonCodec
from ..operators import tree

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of events from Parquet files."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def to_points(events: DataFrame) -> DataFrame:
    """ts, x, y on the finest grid."""
    return events.select("ts", (F.floor("value") % 128).alias("x"), (F.floor(F.col("value") * 3) % 128).alias("y"))


def windowed_counts(points: DataFrame, codec: MortonCodec, level: int, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Points per patch of a level and time window; rows later than ``late`` are dropped by the watermark."""
    shift = codec.rank * (codec.depth - level)
    code = F.shiftright(codec.encode([F.col("x"), F.col("y")], codec.depth), 6 + shift)
    key = F.shiftleft(code, 6 + shift).bitwiseOR(F.lit(level).cast("long"))
    return (
        points.withWatermark("ts", late)
        .groupBy(F.window("ts", window), key.alias("patch_id"))
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "patch_id", "n")
    )


def drain(frame: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all there is now, into Parquet."""
    frame.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(
        availableNow=True
    ).start().awaitTermination()


def refine_from(
    stream: DataFrame,
    leaves: DataFrame,
    codec: MortonCodec,
    flags: Callable[[DataFrame, DataFrame], DataFrame],
    checkpoint: str,
    min_level: int = 1,
) -> DataFrame:
    """Reconstructs the leaf set once a micro-batch; ``flags(leaves, batch)`` gives (patch_id, status)."""
    state = {"leaves": leaves}

    def step(batch: DataFrame, number: int) -> None:
        wanted = flags(state["leaves"], batch).checkpoint()
        state["leaves"] = tree.reconstruct(state["leaves"], wanted, codec, min_level).checkpoint()

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return state["leaves"]
