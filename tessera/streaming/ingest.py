"""Incremental ingestion: alignment files as a stream, with per-window counts and exactly-once merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.reads import ReadFilter, filter_reads


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Alignment text files as they arrive."""
    f = F.split("value", "\t")
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    rows = lines.where("value not like '@%'").withColumn("f", f).where(F.size("f") >= 11)
    return rows.select(F.col("f")[0].alias("qname"), F.col("f")[1].try_cast("int").alias("flag"), F.col("f")[2].alias("rname"), F.col("f")[3].try_cast("bigint").alias("pos"), F.col("f")[5].alias("cigar"), F.col("f")[9].alias("seq"), F.col("f")[10].alias("qual"))


def stream_table(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows per key and time window; rows later than the watermark are left out."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n_rows")).select(F.col("w.start").alias("window_start"), *keys, "n_rows")


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Redelivered rows dropped within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def ingest_filtered(stream: DataFrame, target: str, checkpoint: str, f: ReadFilter = ReadFilter()):
    """Filter each micro-batch and append it under its batch number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        filter_reads(batch, f).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
