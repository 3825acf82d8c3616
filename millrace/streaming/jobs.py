"""Streaming forms of resampling, preparation and scoring."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.profile import _AGGS
from millrace.plans.sizing import scratch_path


def read_stream(spark: SparkSession, path, schema, pattern=None, file_format="parquet", **options):
    reader = spark.readStream.schema(schema).options(**options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.format(file_format).load(path)


def stream_resample(stream: DataFrame, time_column, value, every="1 day", how="mean", late="1 day", by=()):
    """Windowed aggregate with a watermark of ``late``."""
    seen = stream.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, late)
    return seen.groupBy(F.window(time_column, every), *by).agg(_AGGS[how](value).alias("value"), F.count("*").alias("count")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "value", "count")


def run_to_table(stream: DataFrame, output_mode="append", path=None, checkpoint=None):
    """Process everything available and return the written table.

    ``append`` uses the transactional file sink; ``complete`` replaces the whole result per batch.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    checkpoint = checkpoint or scratch_path(spark, "stream-checkpoint")
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if output_mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
