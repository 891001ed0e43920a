"""Invariants of the audit jobs (passed + quarantine + rejects = input, one prompt
per key, positions form a permutation)."""
from pyspark.sql import functions as F

from canopy.operators import canonical as C
from canopy.operators import projects as P
from canopy.sources import fixtures as FX
from canopy.sources.ingest import ingest_requests, split_ingested

SF = "/root/testdata/sf0.001"


def test_partition_of_requests(spark):
    raw = FX.requests(spark, SF)
    ing = ingest_requests(raw)
    ok, rejects = split_ingested(ing)
    free = ok.where(F.col("source") == "freetext")
    specs = ok.where(F.col("source") == "yaml_spec")
    gated = C.gate(C.classify(C.canonicalise(free)))
    passed, quarantine = C.split_gate(gated)
    n = raw.count()
    assert passed.count() + quarantine.count() + specs.count() + rejects.count() == n
    ids = (passed.select("req_id").union(quarantine.select("req_id")).union(specs.select("req_id"))
           .union(rejects.select("req_id")))
    assert ids.distinct().count() == n


def test_one_prompt_per_key(spark):
    passed = C.classify_requests(FX.requests(spark, SF)).where(F.col("confidence") == "HIGH")
    groups = C.collapse_phrasings(passed)
    assert groups.where(F.col("prompts") != 1).count() == 0


def test_build_positions_are_a_permutation(spark):
    out = P.ingest_projects(FX.projects(spark, SF))
    edges = P.link_contracts(out["functions"], out["contracts"])
    items = P.generation_items(out["contracts"], out["functions"], edges)
    pos = P.build_order(items, edges)
    per = pos.groupBy("project_id").agg(F.count("*").alias("n"), F.min("position").alias("lo"),
                                        F.max("position").alias("hi"),
                                        F.count_distinct("position").alias("d"))
    assert per.where((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n"))
                     ).count() == 0


def test_dependencies_come_before_dependents(spark):
    out = P.ingest_projects(FX.projects(spark, SF))
    edges = P.link_contracts(out["functions"], out["contracts"])
    items = P.generation_items(out["contracts"], out["functions"], edges)
    pos = P.build_order(items, edges)
    a = pos.select("project_id", "key", F.col("position").alias("p_key"))
    b = pos.select("project_id", F.col("key").alias("dep"), F.col("position").alias("p_dep"))
    bad = edges.join(a, ["project_id", "key"]).join(b, ["project_id", "dep"]).where(
        F.col("p_dep") >= F.col("p_key"))
    assert bad.count() == 0
