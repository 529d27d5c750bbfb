"""Streaming versions of the cleaning, aggregation, de-duplication, alert and join steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newstide.operators.aggregates import share
from newstide.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Process what is there, append it to a table and read that table; its checkpoint lies next to it.

    A run with the same ``base`` resumes where the last one stopped. Without it table and checkpoint are new ones in
    the shared folder.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{base}/checkpoint")
        .option("path", f"{base}/table")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def run_closed(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    build: Callable[[DataFrame], DataFrame],
    name: str,
    ts: str = "ts",
    base: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """The table of a feed that has ended: everything is processed, then windows that are still open are emitted too.

    ``build`` turns the stream of ``path`` into the result. A second source beside it stays empty until the feed has been read;
    then it gets one row without values that is later than any other. The watermark follows it, so the state store gives up
    what it still holds. Rows that come after that are late: call this once no more will come. A run that was lost before the end
    is resumed by the same ``base``.
    """
    base = base or scratch_path(spark, name)
    closing = f"{base}/closing"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(closing)

    def run() -> DataFrame:
        feed = read_stream(spark, path, schema, files_per_batch).unionByName(read_stream(spark, closing, schema))
        return run_available(build(feed), name, base)

    run()
    last = F.lit("9999-01-01 00:00:00").cast(schema[ts].dataType)
    values = [(last if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    spark.range(1).select(*values).write.mode("append").parquet(closing)
    return run()


def windowed_stats(
    items: DataFrame,
    by: Sequence[str],
    ts: str = "ts",
    score: str = "score",
    label: str = "label",
    length: str = "1 day",
    slide: str | None = None,
    delay: str = "1 day",
) -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) statistics; a window is emitted once the watermark has passed it."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        items.withWatermark(ts, delay)
        .groupBy(window.alias("w"), *by)
        .agg(
            F.avg(score).alias("score_mean"),
            F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("score_std"),
            F.count(F.lit(1)).alias("n_items"),
            share(F.col(label) == "positive").alias("positive_ratio"),
        )
    )


def unique_within(items: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """First row per key among rows closer than ``delay``."""
    return items.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def threshold_alerts(stats: DataFrame, low: float) -> DataFrame:
    return stats.where(F.col("score_mean") < low)


def change_alerts(
    items: DataFrame, by: Sequence[str], drop: float, ts: str = "ts", score: str = "score", delay: str = "1 day"
) -> DataFrame:
    """Days whose mean fell by more than ``drop`` against the day before.

    A two-day window sliding by one day holds both days, so one partially aggregated state per key and window is enough
    and the test itself is stateless.
    """
    pairs = items.withWatermark(ts, delay).select(*by, ts, score, F.window(ts, "2 days", "1 day").alias("w"))
    today = F.col(ts) >= F.col("w.start") + F.expr("interval 1 day")
    means = pairs.groupBy("w", *by).agg(
        F.avg(F.when(today, F.col(score))).alias("score_mean"), F.avg(F.when(~today, F.col(score))).alias("before")
    )
    change = F.col("score_mean") - F.col("before")
    return means.select(
        *by, (F.col("w.start") + F.expr("interval 1 day")).alias("w_start"), "score_mean", change.alias("change")
    ).where(F.col("change") < -drop)


def with_static(items: DataFrame, static: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stream joined with a static table holding one row per key."""
    return items.join(static, list(keys), "left")
