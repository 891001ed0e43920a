"""Log ingest (#3): JSON lines -> typed log table, corrupt lines kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions.frames import settle

LOG_SCHEMA = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("max_tokens", T.LongType()),
    T.StructField("system_prompt_hash", T.StringType()),
    T.StructField("user_prompt", T.StringType()),
    T.StructField("attempt", T.LongType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("finish_reason", T.StringType()),
    T.StructField("tokens_in", T.LongType()),
    T.StructField("tokens_out", T.LongType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("operation", T.StringType()),
    T.StructField("_corrupt", T.StringType()),  # set for a line with a value of a wrong type
])
LOG_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def iso_to_ntz(c: F.Column) -> F.Column:
    """ISO-8601 UTC text ('...Z') -> TIMESTAMP_NTZ in UTC wall time, like the given tables,
    so results do not depend on the session time zone; text that is no time gives NULL."""
    return F.regexp_replace(c, "Z\\z", "").try_cast("timestamp_ntz")


def ingest_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, corrupt).  ``lines`` has one string column ``line``.

    Parsing uses an explicit schema (no inference pass over the data).  A line goes to
    ``corrupt`` if it is not a JSON object with an ``event``, holds a value of a wrong
    type, or has a timestamp that is no time.
    """
    # the filters below read several fields: each line is parsed once (see ``settle``)
    parsed = settle(lines.select("line", F.from_json("line", LOG_SCHEMA, LOG_OPTIONS).alias("r")),
                    ["r"])
    parsed = settle(parsed.withColumn("ts", iso_to_ntz(F.col("r.timestamp"))), ["ts"])
    ok = F.coalesce(F.col("r._corrupt").isNull() & F.col("r.event").isNotNull()
                    & (F.col("ts").isNotNull() | F.col("r.timestamp").isNull()), F.lit(False))
    log = (parsed.where(ok).select("r.*", "ts").drop("_corrupt")
           .withColumn("session_id", F.col("trace_id")))
    corrupt = parsed.where(~ok).select("line")
    return log, corrupt


def read_log_text(spark, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def write_log(log: DataFrame, path: str) -> None:
    """Partitioned sink: one folder per event and day."""
    (log.withColumn("day", F.to_date("ts")).write.mode("overwrite")
     .partitionBy("event", "day").parquet(path))
