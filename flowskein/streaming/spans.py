"""Structured Streaming over captured spans and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowskein.operators.nested import export_spans


def stream_table(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    """Files of a folder as a stream; several files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).option("pathGlobFilter", glob).parquet(folder)


def windowed_counts(events: DataFrame, at: str, by: list[str], width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts per window and group, tumbling or sliding; rows later than the watermark are dropped by a stream."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    counted = events.withWatermark(at, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def sessions(events: DataFrame, at: str, by: str, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of a key: rows no farther apart than the gap."""
    counted = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduped(events: DataFrame, at: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Rows once for each key within the watermark; state is bounded by it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def ingest_spans(stream: DataFrame, target: str, checkpoint: str):
    """Export bodies to a span table, a batch at a time, by the batch operator itself.

    An export that an earlier batch wrote counts no more: the ids that are there
    (one narrow column of the table) are taken off, as exports of one batch are
    settled among themselves. Exports without id are settled within a batch
    only. A batch that is run again replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = export_spans(batch)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            there = spark.read.schema("export_id bigint, batch bigint").parquet(target).filter(F.col("batch") < number)
            new = new.join(there.select("export_id").distinct(), "export_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def matched_spans(clients: DataFrame, servers: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream-stream join of client and server spans of one trace: server's parent is the client."""
    c = clients.withWatermark("started_at", late).alias("c")
    s = servers.withWatermark("started_at", late).alias("s")
    near = F.expr("c.trace_id = s.trace_id AND c.span_id = s.parent_span_id AND s.started_at BETWEEN c.started_at - INTERVAL 1 HOUR AND c.started_at + INTERVAL 1 HOUR")
    return c.join(s, near).select("c.trace_id", F.col("c.span_id").alias("client_span"), F.col("s.span_id").alias("server_span"), F.col("c.service").alias("src_service"), F.col("s.service").alias("dst_service"))
