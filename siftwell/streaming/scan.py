"""Scanning a stream: the same plan, row by row, and windowed counts of findings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.model import Config
from siftwell.operators.report import published
from siftwell.operators.scan import scan


def read_jsonl(spark: SparkSession, folder: str, schema: str = "ts timestamp, path string, text string") -> DataFrame:
    """A stream of JSON lines as segments."""
    return spark.readStream.schema(schema).json(folder)


def scan_stream(segments: DataFrame, config: Config = Config()) -> DataFrame:
    """Published findings of a stream of segments; stateless."""
    return published(scan(segments, config))


def counts(findings: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Findings by event-time window, category and rule; rows later than the watermark are dropped."""
    return findings.withWatermark("ts", late).groupBy(F.window("ts", width), "category", "rule").agg(F.count("*").alias("n_findings"))


def finished(stream: DataFrame) -> DataFrame:
    """What a stream yields once all that is there has been read, by way of a Parquet sink."""
    spark = stream.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="siftwell-")
    at = f"{base.rstrip('/')}/siftwell-stream/{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
