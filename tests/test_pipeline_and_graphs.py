"""Both request branches end to end, deep dependency graphs, parameter lists, spec fields."""
import random

import pytest
from pyspark.sql import functions as F

from canopy import session
from canopy.operators import attempts as A
from canopy.operators import canonical as C
from canopy.operators import drift as D
from canopy.operators import logs as L
from canopy.operators import projects as P
from canopy.operators import replies as R
from canopy.sources import fixtures as FX
from canopy.sources.specs import ingest_specs

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- specs ----
@pytest.mark.parametrize("body,error", [
    ("intent: ~\nverb: add\nnoun: Total\nlanguage: go", "Field must be text: intent"),
    ('{"intent": null, "verb": 1, "noun": "N", "language": "go"}', "Field must be text: intent"),
    ("intent: predicate\nverb: ~\nnoun: N\nlanguage: go", "Field must be text: verb"),
    ("intent: predicate\nverb: 7\nnoun: N\nlanguage: go", "Field must be text: verb"),
    ("intent: predicate\nverb: v\nnoun: {a: b}\nlanguage: go", "Field must be text: noun"),
    ("intent: predicate\nverb: v\nnoun: yes\nlanguage: go", "Field must be text: noun"),
    ("intent: predicate\nverb: v\nnoun: N\nlanguage: ~", "Field must be text: language"),
    ('{"intent": "predicate", "verb": "v", "noun": "N", "language": ["go"]}',
     "Field must be text: language"),
    ("intent: predicate\nverb: v\nnoun: ~\nlanguage: rust", "Field must be text: noun"),
    ("intent: ''\nverb: v\nnoun: N\nlanguage: go", "Unknown intent type: "),
    ("verb: ~\nnoun: N\nlanguage: go", "Missing required field: intent"),
    ("intent: predicate\nverb: v\nnoun: N\nlanguage: go", None)])
def test_spec_fields_must_be_text(spark, body, error):
    r = ingest_specs(spark.createDataFrame([(1, body)], "spec_id long, body string")).first()
    assert r.error == error
    assert (r.confidence == "HIGH") == (error is None)


# ----------------------------------------------------- parameter lists ----
@pytest.mark.parametrize("code,names", [
    ("return max(x, first)", []), ("foo(data)", []), ("if (x) { y(a) }", []),
    ("for (const x of items) {\n}", []), ("while (n1) {}", []),
    ("(userId = g(), a) => 1", ["userId", "a"]),
    ("const f = (p, q = h(x, (y))) => p", ["p", "q"]),
    ("def f(a, b=g(x, y), *rest, **more):\n    return h(a)", ["a", "b", "rest", "more"]),
    ("function f(first, { uid, list: [b] }, ...arr) { return x(y) }",
     ["first", "uid", "list", "arr"]),
    ("func (r *Repo) Save(data []byte, n1 int) error {", ["data", "n1"]),
    ("func total(a, b int) int", ["a", "b"]),
    ("items.map(x => x.id)", ["x"]), ("sorted(items, key=lambda a, b: a)", ["a", "b"]),
    ("class A {\n  async save(uid: Map<string, number>, data = {a: 1}): Promise<void> {\n  }\n}",
     ["uid", "data"]),
    ("async (num1: number, num2 = 'a,b') => num1", ["num1", "num2"]),
    ("", []), ("no code at all", [])])
def test_only_definitions_have_parameters(spark, code, names):
    got = spark.createDataFrame([(code,)], "c string").select(
        R.parameter_names(F.col("c")).alias("p")).first().p
    assert sorted(got) == sorted(names)


def test_unbalanced_and_long_code_ends(spark):
    code = ["(" * 5000, "f(" * 3000 + "x", "def f(" + "a, " * 20_000 + "b):", "(x" * 2000 + ") =>"]
    df = spark.createDataFrame([(c,) for c in code], "c string")
    sizes = [r.n for r in df.select(F.size(R.parameter_names(F.col("c"))).alias("n")).collect()]
    assert sizes[2] == 20_001


# --------------------------------------------------------------- graphs ----
def levels(spark, nodes, edges):
    n = spark.createDataFrame([(x,) for x in nodes], "node long")
    e = spark.createDataFrame(edges, "src long, dst long")
    got = P.build_levels(n, e).collect()
    assert len(got) == len(set(nodes))
    assert all(r.cyclic == (r.level is None) for r in got)
    return {r.node: r.level for r in got}


def brute_levels(nodes, edges):
    deps = {n: {d for s, d in edges if s == n} for n in nodes}
    level: dict[int, int] = {}
    while True:
        ready = [n for n in deps if n not in level and all(d in level for d in deps[n])]
        if not ready:
            return {n: level.get(n) for n in deps}
        level |= {n: 1 + max((level[d] for d in deps[n]), default=-1) for n in ready}


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(40))
    edges = [(s, rng.randrange(s)) for s in range(1, 40) for _ in range(rng.choice([0, 1, 1, 1, 3]))]
    edges += [(rng.randrange(40), rng.randrange(41)) for _ in range(seed)]  # cycles, absent nodes
    edges += [(99, 1)]  # an edge of a node that is not there
    assert levels(spark, nodes, edges) == brute_levels(nodes, edges)


def test_cycles_of_single_dependencies_and_what_hangs_on_them(spark):
    nodes = list(range(1, 12))
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 6), (7, 5), (7, 8), (9, 8), (10, 99),
             (11, 10)]
    got = levels(spark, nodes, edges)
    assert got == brute_levels(nodes, edges)
    assert {n for n, x in got.items() if x is None} == {1, 2, 3, 4, 5, 6, 7, 10, 11}


def test_a_deep_chain_takes_few_rounds_and_little_storage(spark, tmp_path, monkeypatch):
    depth = 5000
    for module in (session, P):
        monkeypatch.setattr(module, "ensure_checkpoint_dir", lambda spark: str(tmp_path))
    chain = spark.range(1, depth).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("deep-chain", "levels")
    got = P.build_levels(spark.range(depth).toDF("node"), chain)
    jobs = len(tracker.getJobIdsForGroup("deep-chain"))
    spark.sparkContext.setJobGroup("after", "")
    assert got.where("level <> node OR cyclic").count() == 0 and got.count() == depth
    rows = {f.name.rsplit("-", 1)[0]: spark.read.parquet(str(f)).count()
            for f in tmp_path.iterdir()}
    # one row a node or edge each; the rounds' former pointers are gone
    assert rows["chains"] == depth - 1 and max(rows.values()) == depth
    assert sum(rows.values()) <= 4 * depth
    assert len(list(tmp_path.iterdir())) == len(rows)
    # five rounds of three joins; adaptive execution runs each shuffle as a job of its own
    assert jobs < 80


# --------------------------------------------------------- whole pipeline ----
@pytest.fixture(scope="module")
def everything(spark):
    from canopy.session import stored
    classified = stored(C.classify_all(FX.mixed_requests(spark, SF)), "test-classified")
    results = stored(A.resolve_attempts(R.validate_replies(FX.mixed_attempts(spark, SF))),
                     "test-results")
    return classified, results


def test_every_request_is_accepted_or_has_one_reason(spark, everything):
    classified, results = everything
    n = FX.mixed_requests(spark, SF).count()
    assert classified.count() == n
    outcomes = L.request_outcomes(classified, results)
    per = L.funnel_counts(outcomes)
    stages = {r.stage: r.n for r in L.pipeline_funnel(per).collect()}
    lost = L.funnel_losses(per).collect()
    assert stages["requests"] == n
    assert sum(r.n for r in lost) == n - stages["accepted"]
    for a, b in zip(L.FUNNEL, L.FUNNEL[1:]):
        assert sum(r.n for r in lost if r.lost_after == a) == stages[a] - stages[b]
    # specs lose requests to their own errors and never to the gate
    spec = {(r.lost_after, r.reason) for r in lost if r.source == "yaml_spec"}
    assert ("ingested", "Missing required field") in spec
    assert ("ingested", "Field must be text") in spec
    assert not {r for stage, r in spec if stage == "understood"}
    assert ("answered", "failed") in spec and ("passed_gate", "no result") in spec
    # no reason carries a row's own text
    assert all(len(r.reason) < 40 for r in lost)


def test_specs_share_intent_keys_and_prompts_with_free_text(spark, everything):
    classified, _ = everything
    free = classified.where("source = 'freetext' AND confidence = 'HIGH'")
    spec = classified.where("source <> 'freetext' AND error IS NULL")
    assert spec.count() > 0
    r = spec.where("noun = 'Total'").first()
    assert (r.verb, r.language, r.intent_type, r.confidence) == (
        "add", "javascript", "PURE_FUNCTION", "HIGH")
    assert r.intent_key == spark.range(1).select(
        F.md5(F.lit("add:Total:javascript:PURE_FUNCTION"))).first()[0]
    bound = C.bind_prompts(spec.unionByName(free))
    assert bound.where("prompt_id IS NULL").count() == 0


def test_drift_over_the_pipelines_own_results(spark, everything):
    classified, results = everything
    rows = D.resolved_results(classified, results)
    checked = D.check_drift(rows)
    assert checked.count() == rows.count() > 0
    bad = checked.where("violation").first()
    assert bad.expected != bad.content_hash and bad.expected in bad.message
    # without a result or a passed gate there is nothing to check
    assert rows.join(results, "req_id", "left_anti").count() == 0
    assert rows.where("intent_key IS NULL").count() == 0


def test_system_prompt_is_stored_once_under_its_hash(spark):
    texts = C.system_prompts(spark, ["one", "two", "one"])
    assert texts.count() == 2
    work = C.bind_system_prompt(spark.range(3), "two")
    assert work.join(texts, "system_prompt_hash").where("system_prompt = 'two'").count() == 3


def test_undeclared_ambiguity_is_flagged(spark):
    body = "type: PREDICATE\nconfidence: {}\ncanonical_verb: check\ncanonical_noun: Age"
    sections = spark.createDataFrame(
        [(i, 1, body.format(c)) for i, c in enumerate(["HIGH", "MEDIUM", "LOW"])] + [(3, 1, "x")],
        "req_id long, attempt int, intent_classification string")
    got = {r.req_id: (r.declared_verb, r.declared_noun, r.unflagged)
           for r in R.declared_classification(sections).collect()}
    assert got == {0: ("check", "Age", False), 1: ("check", "Age", True),
                   2: ("check", "Age", True), 3: (None, None, False)}


def test_repeated_names_of_a_large_project(spark):
    import json
    names = [f"m{i}" for i in range(3000)]
    spec = {"project": {"name": "p", "language": "go", "modules": [
        {"name": n, "functions": ["f"]} for n in [*names, "m17"]]}}
    df = spark.createDataFrame([(1, json.dumps(spec))], "project_id long, spec_json string")
    out = P.ingest_projects(df)["violations"].collect()
    assert [r.error for r in out] == ["Duplicate module name: 'm17'"]
