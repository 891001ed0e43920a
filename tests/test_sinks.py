"""Sinks: registry JSON lines, partitioned reports, partitioned log table."""
import json
import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from canopy.operators import registry as G
from canopy.plans import catalog
from canopy.sources import fixtures as FX
from canopy.sources.logs import ingest_log, read_log_text, write_log

SF = "/root/testdata/sf0.001"


def test_registry_export_json_lines(spark):
    reg = catalog._registry(spark, SF)[0]
    out = tempfile.mkdtemp(prefix="canopy-test-reg-")
    G.registry_export(reg, out + "/reg")
    lines = [r.value for r in spark.read.text(out + "/reg").collect()]
    objs = [json.loads(x) for x in lines]
    assert len(objs) == reg.count()
    assert list(objs[0].keys()) == ["content_hash", "intent_classification", "signature",
                                    "implementation", "invariants", "test_oracle", "dependencies"]


def test_report_export_partitioned(spark):
    res = (catalog._registry_input(spark, SF)
           .withColumn("unclear_dimension", F.lit(None).cast("string"))
           .withColumn("clarifying_question", F.lit(None).cast("string"))
           .withColumn("assumed_interpretation", F.lit(None).cast("string")))
    out = tempfile.mkdtemp(prefix="canopy-test-rep-") + "/rep"
    G.report_export(res, out)
    assert sorted(d for d in os.listdir(out) if d.startswith("status=")) == [
        "status=ambiguity", "status=failed", "status=ok"]
    ok = spark.read.text(out + "/status=ok").first().value
    assert ok.startswith("=== Intent Classification ===")


def test_log_roundtrip_text_and_partitioned_sink(spark):
    tmp = tempfile.mkdtemp(prefix="canopy-test-log-")
    FX.log_lines(spark, SF).write.text(tmp + "/lines")
    log, corrupt = ingest_log(read_log_text(spark, tmp + "/lines"))
    assert corrupt.count() == spark.read.parquet(f"{SF}/events.parquet").where(
        (F.col("event_id") % 1000).isin(7, 13, 17)).count()
    write_log(log, tmp + "/log")
    back = spark.read.parquet(tmp + "/log")
    assert back.count() == log.count()
    assert {"event", "day"} <= set(back.columns)


def test_conversations_classified(spark):
    df = E.queries()["classify_conversations"](spark, SF)
    assert df.count() > 0
