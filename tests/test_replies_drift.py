"""Literal cases for replies, attempts, drift, dependencies and the splitter."""
from pyspark.sql import functions as F

from canopy.operators import attempts as A
from canopy.operators import drift as D
from canopy.operators import projects as P
from canopy.operators import replies as R
from canopy.operators import canonical as C
from canopy.sources import fixtures as FX


def _attempts(spark, raws):
    rows = [(i, 1, None, 1, 0, r) for i, r in enumerate(raws)]
    return spark.createDataFrame(
        rows, "req_id long, session_id long, ts timestamp, attempt int, tpl_id int, raw string")


def test_templates_status_and_hash(spark):
    got = {r.req_id: (r.status, r.content_hash) for r in
           R.validate_replies(_attempts(spark, FX.REPLY_TEMPLATES)).collect()}
    assert got[0] == ("ok", "a2a69ff27caa2bdf")
    assert got[1] == ("ok", "62e46070ace177cd")
    assert got[2][0] == "missing_section"
    assert got[3] == ("ambiguity", "")
    assert got[4][0] == "no_sections"
    assert got[5][0] == "fence_multiple"
    assert got[6][0] == "import"
    assert got[7] == ("ok", "a2a69ff27caa2bdf")


def test_repeated_section_last_wins_and_require_inside_line(spark):
    raw = FX.REPLY_TEMPLATES[0] + "\n---SIGNATURE---\nsecond\n"
    raw2 = FX.REPLY_TEMPLATES[0].replace("firstNumber + secondNumber;", "require('y');")
    raw2 = raw2.replace("const total = (firstNumber, secondNumber) => require('y');",
                        "const x = require('y')")
    v = R.validate_replies(_attempts(spark, [raw, raw2]))
    s = {r.req_id: r for r in R.pivot_sections(v).collect()}
    assert s[0].signature == "second"
    assert 1 in s  # require( not at line start passes


def test_empty_code_fails(spark):
    raw = FX.REPLY_TEMPLATES[0].replace(
        "const total = (firstNumber, secondNumber) => firstNumber + secondNumber;", "")
    assert R.validate_replies(_attempts(spark, [raw])).first().status == "empty_code"


def test_resolve_first_terminal_and_failed(spark):
    rows = [(1, 1, "fence_missing", None), (1, 2, "ok", "h"), (1, 3, "ok", "g"),
            (2, 1, "import", None), (2, 2, "no_sections", None), (2, 3, "import", None),
            (3, 1, "ambiguity", "")]
    v = spark.createDataFrame(rows, "req_id long, attempt int, status string, content_hash string")
    got = {r.req_id: (r.status, r.attempts_used, r.content_hash, r.error)
           for r in A.resolve_attempts(v).collect()}
    assert got[1] == ("ok", 2, "h", None)
    assert got[2] == ("failed", 3, "", "Schema validation failed after 3 attempts")
    assert got[3] == ("ambiguity", 1, "", None)


def test_drift_cases(spark):
    # key1: a, a -> ok; key2: a, b -> violation; after reset b accepted; expected stays a
    rows = [(1, 0, "2024-01-01 00:00:01", "key1", "a", 0), (2, 0, "2024-01-01 00:00:02", "key1", "a", 0),
            (3, 0, "2024-01-01 00:00:03", "key2", "a", 0), (4, 0, "2024-01-01 00:00:04", "key2", "b", 0),
            (5, 0, "2024-01-01 00:00:05", "key2", "a", 0), (6, 0, "2024-01-01 00:00:06", "key2", "b", 1)]
    df = spark.createDataFrame(rows, "req_id long, session_id long, ts string, intent_key string, "
                                     "content_hash string, is_reset int").withColumn(
        "ts", F.to_timestamp("ts"))
    got = {r.req_id: (r.session_no, r.violation, r.message) for r in D.check_drift(df).collect()}
    assert [got[i][1] for i in range(1, 7)] == [False, False, False, True, False, False]
    assert got[6][0] == 1
    assert got[4][2] == ("DETERMINISM_VIOLATION\n  intent_key: key2\n  expected:   a\n"
                         "  received:   b\n  Investigate before re-running.")


def test_dependencies_lines(spark):
    secs = spark.createDataFrame(
        [(1, 1, "axios\nlodash"), (2, 1, "numpy as np"), (3, 1, "- axios\n- lodash\n- dayjs"),
         (4, 1, "# Runtime deps\naxios\n\n# Dev deps\njest"), (5, 1, "- numpy as np")],
        "req_id long, attempt int, dependencies string")
    got = sorted((r.req_id, r.module, r.alias) for r in P.extract_dependencies(secs).collect())
    assert got == [(1, "axios", None), (1, "lodash", None), (2, "numpy", "np"),
                   (3, "axios", None), (3, "dayjs", None), (3, "lodash", None),
                   (4, "axios", None), (4, "jest", None), (5, "- numpy", "np")]
    deps = P.extract_dependencies(secs.where("req_id in (1, 2)"))
    langs = spark.createDataFrame([(1, "javascript"), (2, "python")], "req_id long, language string")
    st = sorted(r.statement for r in P.render_imports(deps, langs).collect())
    assert st == ["import axios from 'axios';", "import lodash from 'lodash';", "import numpy as np"]


def test_splitter_cases(spark):
    texts = FX.MULTI_PHRASES
    df = spark.createDataFrame(list(enumerate(texts)), "req_id long, text string")
    parts = {}
    for r in C.split_requests(df).collect():
        parts.setdefault(r.req_id, []).append((r.pos, r.sub_text))
    n = {i: len(v) for i, v in parts.items()}
    assert [n[i] for i in range(len(texts))] == [1, 1, 1, 1, 2, 2, 2, 2]
    assert sorted(parts[4]) == [(0, "write add"), (1, "subtract functions")]
    assert sorted(parts[7]) == [(0, "add two numbers"), (1, "check if even")]


def test_build_order_project_fixture(spark):
    out = P.ingest_projects(FX.projects(spark, "/root/testdata/sf0.001").where("project_id = 0"))
    edges = P.link_contracts(out["functions"], out["contracts"])
    items = P.generation_items(out["contracts"], out["functions"], edges)
    order = [r.key for r in P.build_order(items, edges).orderBy("position").collect()]
    assert order == ["auth:hash password", "contract:AuthToken", "contract:User",
                     "auth:generate AuthToken for User", "user:create User in database",
                     "user:fetch User by id", "validation:check if User exists",
                     "validation:validate email format"]


def test_build_levels_cycle_and_absent(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 1), (5, 6), (6, 5), (7, 99)],
                                  "src long, dst long")
    got = {r.node: (r.level, r.cyclic) for r in P.build_levels(nodes, edges).collect()}
    assert got[1] == (0, False) and got[2] == (1, False) and got[3] == (2, False)
    assert got[5][1] and got[6][1] and got[7][1]


def test_repartition_invariance(spark):
    from canopy.operators.canonical import classify_requests
    raw = FX.requests(spark, "/root/testdata/sf0.001")
    a = classify_requests(raw.coalesce(1)).select("req_id", "intent_key", "confidence")
    b = classify_requests(raw.repartition(7)).select("req_id", "intent_key", "confidence")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_session_numbers_do_not_depend_on_partitions(spark):
    r = FX.results_seq(spark, "/root/testdata/sf0.001")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in (1, 23):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, D.assign_sessions(r).select(
            "req_id", "session_no").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_settle_keeps_scan_pushdown(spark):
    from canopy.plans import catalog
    df = catalog._classified(spark, "/root/testdata/sf0.001").where(F.col("session_id") == 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,5)" in plan


def test_link_contracts_substring_semantics(spark):
    fns = spark.createDataFrame(
        [(1, "m", 0, 0, "check USERNAME length"), (1, "m", 0, 1, "hash pw"), (2, "x", 0, 0, "user")],
        "project_id long, module string, m_pos int, f_pos int, intent string")
    cons = spark.createDataFrame([(1, "User"), (1, "Token"), (2, "Users")],
                                 "project_id long, contract string")
    got = sorted((r.project_id, r.key, r.dep) for r in P.link_contracts(fns, cons).collect())
    assert got == [(1, "m:check USERNAME length", "contract:User")]
