"""Project specs, dependencies and build order (#4, #38-#45).

Specs are JSON text (YAML is turned into JSON first) parsed into VARIANT once;
every check is a column expression over the parsed value or over exploded
entries of one project, and the first error per project (in the order the
audited parser checks them) is picked with ``min_by`` -- one small aggregation
per project.  The checked entries are written once and all later operators
read them.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import dims
from canopy.functions import text as T
from canopy.functions.frames import join_on, running_sum, settle
from canopy.session import discard, ensure_checkpoint_dir, stored
from canopy.sources.specs import yaml_value

ERRORS = dims.PROJECT_ERRORS
_SUPPORTED = "[" + ", ".join(f"'{x}'" for x in sorted(dims.PROJECT_LANGUAGES)) + "]"


def _get(v, path, typ="variant"):
    return F.try_variant_get(v, path, typ)


def _kind(v):
    """Coarse JSON type of a variant: OBJECT / ARRAY / STRING / other / NULL."""
    s = F.schema_of_variant(v)
    return (F.when(v.isNull() | F.is_variant_null(v), F.lit(None))
            .when(s.startswith("OBJECT"), "OBJECT").when(s.startswith("ARRAY"), "ARRAY")
            .when(s == "STRING", "STRING").otherwise("OTHER"))


def _req_err(val: F.Column, kind: F.Column, key: str, place: F.Column) -> F.Column:
    """Error of a required text that is absent or empty, NULL when the value is fine."""
    values = {"key": F.lit(key), "place": place}
    return (F.when(val.isNull(), T.fill(ERRORS["missing_field"], **values))
            .when((kind != "STRING") | (T.py_strip(_get(val, "$", "string")) == ""),
                  T.fill(ERRORS["empty_field"], **values)))


def _with_parts(df: DataFrame, src: str, keys: list[str], prefix: str) -> DataFrame:
    """Add ``{prefix}{key}`` (variant) and ``{prefix}{key}_k`` (kind) columns."""
    for k in keys:
        df = df.withColumn(f"{prefix}{k}", _get(F.col(src), f"$.{k}"))
    for k in keys:
        df = df.withColumn(f"{prefix}{k}_k", _kind(F.col(f"{prefix}{k}")))
    return df


def _order(stage: int, m_pos=None, f_pos=None) -> F.Column:
    """Place of a check in the order of the audited parser."""
    at = [F.lit(-1) if p is None else F.col(p).cast("int") for p in (m_pos, f_pos)]
    return F.struct(F.lit(stage).alias("stage"), at[0].alias("m"), at[1].alias("f"))


def _specs_to_json(batches):
    """JSON text or an error for specs that the JVM cannot parse: JSON with a repeated key
    (the last one counts) and YAML."""
    for pdf in batches:
        out = []
        for body in pdf["spec_json"]:
            try:
                value = yaml_value(body or "")
                out.append((json.dumps(value, default=str), None))
            except ValueError as exc:
                out.append((None, f"Invalid YAML: {exc}"))
        yield pd.DataFrame({"project_id": pdf["project_id"], "spec_json": [x[0] for x in out],
                            "spec_error": [x[1] for x in out]})


def specs_as_json(projects: DataFrame) -> DataFrame:
    """(project_id, spec_json, spec_error); rows that are JSON already stay on the JVM."""
    rows = projects.select("project_id", "spec_json")
    on_jvm = F.try_parse_json("spec_json").isNotNull()
    kind = rows.schema["project_id"].dataType.simpleString()
    rest = rows.where(~on_jvm).mapInPandas(
        _specs_to_json, f"project_id {kind}, spec_json string, spec_error string")
    return rows.where(on_jvm).withColumn(
        "spec_error", F.lit(None).cast("string")).unionByName(rest)


def ingest_projects(projects: DataFrame) -> dict[str, DataFrame]:
    """Flatten ``projects(project_id, spec_json)``.

    Returns dict with ``parsed`` (one row per project: name, language, arrays),
    ``violations`` (project_id, error), ``contracts``, ``modules``, ``functions``
    (only for projects without a violation).  Every variant path is extracted
    once into its own column, so the checks stay small expressions.  The violations alone
    need two stored tables; function entries and violations are stored for the others.
    """
    p = (specs_as_json(projects).withColumn("v", F.try_parse_json("spec_json"))
         .withColumn("v_k", _kind(F.col("v")))
         .withColumn("proj", _get(F.col("v"), "$.project"))
         .withColumn("proj_k", _kind(F.col("proj"))))
    p = _with_parts(p, "proj", ["name", "language", "data_contracts", "modules"], "p_")
    lang_raw = F.lower(T.py_strip(_get(F.col("p_language"), "$", "string")))
    name_err = _req_err(F.col("p_name"), F.col("p_name_k"), "name", F.lit("project"))
    lang_err = _req_err(F.col("p_language"), F.col("p_language_k"), "language", F.lit("project"))
    top = (F.when(F.col("spec_error").isNotNull(), F.col("spec_error"))
           .when(F.coalesce(F.col("v_k") != "OBJECT", F.lit(True)),
                 ERRORS["not_a_mapping"])
           .when(F.col("proj").isNull(), ERRORS["no_project"])
           .when(F.col("proj_k") != "OBJECT", ERRORS["project_kind"])
           .when(name_err.isNotNull(), name_err)
           .when(lang_err.isNotNull(), lang_err)
           .when(~F.col("language").isin(dims.PROJECT_LANGUAGES),
                 T.fill(ERRORS["language"], language=F.col("language"),
                        supported=F.lit(_SUPPORTED)))
           .when(F.col("p_data_contracts").isNotNull() & (F.col("p_data_contracts_k") != "ARRAY"),
                 ERRORS["contracts_kind"]))
    empty_arr = F.array().cast("array<variant>")
    parsed = (p.withColumn("language", lang_raw)
              .select("project_id", "spec_json", top.alias("top_error"),
                      T.py_strip(_get(F.col("p_name"), "$", "string")).alias("name"), "language",
                      F.coalesce(_get(F.col("p_data_contracts"), "$", "array<variant>"),
                                 empty_arr).alias("dcs"),
                      F.col("p_modules").alias("mods_v"), F.col("p_modules_k").alias("mods_k"),
                      F.coalesce(_get(F.col("p_modules"), "$", "array<variant>"),
                                 empty_arr).alias("mods"))
              .transform(settle))
    parsed = stored(parsed, "project-specs")

    # contract entries ------------------------------------------------------
    ce = (parsed.where(F.col("top_error").isNull())
          .select("project_id", F.posexplode("dcs").alias("c_pos", "e"))
          .withColumn("e_k", _kind(F.col("e"))))
    ce = _with_parts(ce, "e", ["name", "fields"], "e_")
    cname = T.py_strip(_get(F.col("e_name"), "$", "string"))
    ctx = F.concat(F.lit("data_contracts["), F.col("c_pos").cast("string"), F.lit("]"))
    c_name_err = _req_err(F.col("e_name"), F.col("e_name_k"), "name", ctx)
    c_err = (F.when(F.col("e_k") != "OBJECT", T.fill(ERRORS["entry_kind"], place=ctx))
             .when(c_name_err.isNotNull(), c_name_err))
    c_late = (F.when((F.col("e_fields_k") != "OBJECT")
                   | (F.size(_get(F.col("e_fields"), "$", "map<string,variant>")) == 0),
                   T.fill(ERRORS["no_fields"], place=ctx, name=cname)))
    ce = ce.select("project_id", "c_pos", cname.alias("cname"), c_err.alias("early"),
                   c_late.alias("late")).transform(settle)
    c_errors = _named_once(ce, "cname", "c_pos", ERRORS["repeated_contract"]).select(
        "project_id", _order(1, "c_pos").alias("ord"), "error")

    # module entries --------------------------------------------------------
    me = (parsed.where(F.col("top_error").isNull())
          .select("project_id", F.posexplode("mods").alias("m_pos", "e"))
          .withColumn("e_k", _kind(F.col("e"))))
    me = _with_parts(me, "e", ["name", "functions"], "e_")
    mname = T.py_strip(_get(F.col("e_name"), "$", "string"))
    mctx = F.concat(F.lit("modules["), F.col("m_pos").cast("string"), F.lit("]"))
    m_name_err = _req_err(F.col("e_name"), F.col("e_name_k"), "name", mctx)
    fn_arr = _get(F.col("e_functions"), "$", "array<variant>")
    m_err = (F.when(F.col("e_k") != "OBJECT", T.fill(ERRORS["entry_kind"], place=mctx))
             .when(m_name_err.isNotNull(), m_name_err))
    m_late = (F.when((F.col("e_functions_k") != "ARRAY") | (F.size(fn_arr) == 0),
                   T.fill(ERRORS["no_functions"], place=mctx, name=mname)))
    me = me.select("project_id", "m_pos", mname.alias("module"), m_err.alias("early"),
                   m_late.alias("late"), fn_arr.alias("fns")).transform(settle)
    me = stored(_named_once(me, "module", "m_pos", ERRORS["repeated_module"]),
                "project-modules")
    m_errors = me.select("project_id", _order(3, "m_pos").alias("ord"),
                         "error")
    fe = (me.where(F.col("error").isNull())
          .select("project_id", "m_pos", "module", F.posexplode("fns").alias("f_pos", "f"))
          .withColumn("f_k", _kind(F.col("f"))))
    fe = _with_parts(fe, "f", ["intent", "language"], "f_")
    fctx = F.concat(F.lit("modules["), F.col("m_pos").cast("string"), F.lit("].functions["),
                    F.col("f_pos").cast("string"), F.lit("]"))
    f_intent_err = _req_err(F.col("f_intent"), F.col("f_intent_k"), "intent", fctx)
    f_err = (F.when(F.col("f_k") == "OBJECT",
                    F.when(f_intent_err.isNotNull(), f_intent_err))
             .when(F.col("f_k") != "STRING", T.fill(ERRORS["function_kind"], place=fctx)))
    fe = fe.withColumn("error", f_err).transform(settle)

    ok_top = parsed.where(F.col("top_error").isNull())
    mods_err = ok_top.select(
        "project_id", _order(2).alias("ord"),
        F.when(F.col("mods_v").isNotNull() & (F.col("mods_k") != "ARRAY"),
               F.lit(ERRORS["modules_kind"])).alias("error"))
    empty = ok_top.select(
        "project_id", _order(9).alias("ord"),
        F.when((F.size("dcs") == 0) & (F.size("mods") == 0),
               F.lit(ERRORS["empty_project"])).alias("error"))
    tops = parsed.select("project_id", _order(0).alias("ord"), F.col("top_error").alias("error"))

    def violations_of(entries: DataFrame) -> DataFrame:
        cand = tops
        for g in (c_errors, mods_err, m_errors, entries.select(
                "project_id", _order(3, "m_pos", "f_pos").alias("ord"), "error"), empty):
            cand = cand.unionByName(g)
        return (cand.where(F.col("error").isNotNull()).groupBy("project_id")
                .agg(F.min_by("error", "ord").alias("error")))

    def accepted() -> tuple[DataFrame, DataFrame]:
        """(projects without a violation, function entries), each stored once."""
        if "good" not in tables.held:
            entries = stored(fe, "project-functions")
            bad = stored(violations_of(entries), "project-violations")
            tables.held["good"] = (parsed.join(bad.select("project_id"), "project_id",
                                               "left_anti"), entries)
        return tables.held["good"]

    def contracts() -> DataFrame:
        typed = F.from_json("spec_json", "project struct<description string, data_contracts array"
                            "<struct<name string, description string, fields map<string,string>>>>")
        return (accepted()[0].select(
            "project_id", "name", "language",
            F.posexplode(typed["project"]["data_contracts"]).alias("c_pos", "c"))
            .select("project_id", F.col("name").alias("project"), "language", "c_pos",
                    T.py_strip(F.col("c.name")).alias("contract"),
                    F.coalesce(F.col("c.description"), F.lit("")).alias("description"),
                    F.col("c.fields").alias("fields")))

    def modules() -> DataFrame:
        return me.join(accepted()[0].select("project_id"), "project_id", "left_semi").select(
            "project_id", "m_pos", "module")

    def functions() -> DataFrame:
        good, entries = accepted()
        return (entries.join(good.select("project_id", "language"), "project_id")
                .select("project_id", F.col("language").alias("project_language"), "m_pos",
                        "module", "f_pos",
                        F.coalesce(T.py_strip(_get(F.col("f_intent"), "$", "string")),
                                   T.py_strip(_get(F.col("f"), "$", "string"))).alias("intent"),
                        F.lower(T.py_strip(_get(F.col("f_language"), "$", "string")))
                        .alias("language_override")))

    tables = _Tables({"parsed": lambda: parsed, "violations": lambda: violations_of(fe),
                      "contracts": contracts, "modules": modules, "functions": functions})
    return tables


class _Tables(dict):
    """Tables that are planned when they are first asked for."""

    def __init__(self, makers):
        super().__init__()
        self.makers, self.held = makers, {}

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.makers[name]()
        return self[name]


def _named_once(entries: DataFrame, name: str, pos: str, text: str) -> DataFrame:
    """``error`` of project entries: ``early``, else a name that an earlier entry has, else
    ``late``.  Names meet by grouping, so a project of many entries forms no name lists."""
    same = Window.partitionBy("project_id", name)
    repeated = F.col(pos) > F.min(pos).over(same)
    return entries.withColumn("error", F.coalesce(
        "early", F.when(repeated, T.fill(text, name=F.col(name))), "late")) \
        .drop("early", "late")


# ---------------------------------------------------------------- #41 ----
def link_contracts(functions: DataFrame, contracts: DataFrame) -> DataFrame:
    """edges(project_id, key, dep): a function depends on each contract of its
    project whose lowered name is a substring of the lowered intent.

    Substring containment is turned into an equi-join without pairing every
    function with every contract: each intent emits its substrings of the
    lengths that contract names of its project actually have (linear in the
    intent length), and those are joined on (project_id, text) with the names.
    """
    c = contracts.select("project_id", "contract", F.lower("contract").alias("_lc"))
    lens = c.groupBy("project_id").agg(F.collect_set(F.length("_lc")).alias("_lens"))
    f = (functions.select("project_id", F.concat_ws(":", "module", "intent").alias("key"),
                          F.lower("intent").alias("_li"))
         .join(lens, "project_id"))
    fits = F.filter("_lens", lambda m: m <= F.length("_li"))
    subs = F.flatten(F.transform(fits, lambda m: F.transform(
        F.sequence(F.lit(1), F.length("_li") - m + 1),
        lambda i: F.substring(F.col("_li"), i, m))))
    cand = f.select("project_id", "key", F.explode(F.array_distinct(subs)).alias("_lc"))
    return (cand.join(c, ["project_id", "_lc"])
            .select("project_id", "key", F.concat(F.lit("contract:"), F.col("contract")).alias("dep"))
            .distinct())


# ---------------------------------------------------------------- #42 ----
def contract_intent(contracts: DataFrame) -> F.Column:
    fields = F.array_join(F.transform(F.map_entries("fields"),
                                      lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    base = F.concat(F.lit("define "), F.col("contract"), F.lit(" type with fields "), fields)
    return F.when(F.col("description") != "", F.concat(base, F.lit(". "), F.col("description"))
                  ).otherwise(base)


def generation_items(contracts: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """items(project_id, key, intent, language, module, n_deps, deps); a later
    function with the same key replaces the earlier one."""
    c = contracts.select("project_id", F.concat(F.lit("contract:"), "contract").alias("key"),
                         contract_intent(contracts).alias("intent"), "language",
                         F.lit(None).cast("string").alias("module"),
                         F.struct(F.lit(0).alias("k"), F.col("c_pos").alias("a"), F.lit(0).cast("int").alias("b")).alias("_ord"))
    f = functions.select("project_id", F.concat_ws(":", "module", "intent").alias("key"), "intent",
                         F.coalesce("language_override", "project_language").alias("language"),
                         "module", F.struct(F.lit(1).alias("k"), F.col("m_pos").alias("a"), F.col("f_pos").cast("int").alias("b")).alias("_ord"))
    items = (c.unionByName(f).groupBy("project_id", "key")
             .agg(F.max_by(F.struct("intent", "language", "module"), "_ord").alias("i"))
             .select("project_id", "key", "i.*"))
    d = edges.groupBy("project_id", "key").agg(
        F.array_join(F.sort_array(F.collect_list("dep")), ",").alias("deps"),
        F.count("*").alias("n_deps"), F.max("dep").alias("max_dep"))
    return (items.join(d, ["project_id", "key"], "left")
            .withColumn("n_deps", F.coalesce("n_deps", F.lit(0)))
            .withColumn("deps", F.coalesce("deps", F.lit(""))))


# ---------------------------------------------------------------- #43 ----
def build_order(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Lexicographically smallest topological order per project.

    With contracts free of dependencies and functions depending only on
    contracts, the sorted-queue order is ``(eff, eff <> key, key)`` with
    ``eff = greatest(key, max(dep))``: a function becomes ready right after its
    largest dependency and is then the next smallest ready key.  Positions are prefix sums
    over range partitions, so a large project spans several tasks."""
    if "max_dep" in items.columns:  # carried by generation_items: no second pass over edges
        j = items.withColumn("_maxdep", F.col("max_dep"))
    else:
        m = edges.groupBy("project_id", "key").agg(F.max("dep").alias("_maxdep"))
        j = items.join(m, ["project_id", "key"], "left")
    j = j.withColumn("eff", F.greatest("key", F.coalesce("_maxdep", "key")))
    j = j.select("project_id", "key", "eff", (F.col("eff") != F.col("key")).alias("follows"),
                 F.lit(1).alias("one"))
    return running_sum(j, "project_id", ["eff", "follows", "key"], "one", "position").select(
        "project_id", "key", "position")


# ---------------------------------------------------------------- #44 ----
def contract_chains(chain: DataFrame, jumps: int = 3) -> DataFrame:
    """(node, anchor, dist): where each node's chain of single dependencies ends.

    ``chain`` has (node, to) of the nodes with exactly one dependency.  Pointers are doubled
    ``jumps`` times a round (``to`` becomes ``to`` of ``to``), so a chain of n nodes takes
    log(n) / log(2 ** jumps) rounds.  A pointer that still moves when twice the longest
    possible chain is behind it runs in a cycle or into one: its anchor is null.  Two rounds'
    rows are stored at a time."""
    held = stored(chain.withColumn("dist", F.lit(1).cast("long"))
                  .withColumn("moves", F.lit(True)), "chains")
    limit = held.count()  # no chain is longer
    reach = 1
    while True:
        step = held
        for _ in range(jumps):
            ahead = step.select(F.col("node").alias("_n"), F.col("to").alias("_t"),
                                F.col("dist").alias("_d"))
            step = step.join(ahead, F.col("to") == F.col("_n"), "left").select(
                "node", F.coalesce("_t", "to").alias("to"),
                (F.col("dist") + F.coalesce("_d", F.lit(0))).alias("dist"),
                F.col("_n").isNotNull().alias("moves"))
        following = stored(step, "chains")
        discard(held)
        held, reach = following, reach << jumps
        if reach > 2 * limit or held.where("moves").isEmpty():
            break
    return held.select("node", F.when(~F.col("moves"), F.col("to")).alias("anchor"), "dist")


def build_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of every node of a general dependency DAG (edges: src depends on dst).

    Chains of nodes with a single dependency are contracted first (``contract_chains``): their
    level is that of the chain's end plus the distance.  Kahn's algorithm then runs over the
    other nodes in rounds until no node is released: a round counts, for the nodes that wait,
    the dependencies met by the last frontier and the largest level they ask for.  Nodes never
    released (cycles, or a dependency on an absent node) get ``level = NULL, cyclic = true``.

    A round writes its frontier, all rounds into one folder, and the nodes that still wait,
    whose former folder is removed.
    """
    nodes = stored(nodes.select("node").distinct(), "levels-nodes")
    e = stored(edges.select("src", "dst").distinct().join(
        nodes.withColumnRenamed("node", "src"), "src", "left_semi"), "levels-edges")
    degree = stored(e.groupBy(F.col("src").alias("node")).agg(
        F.count("*").alias("remaining"), F.min("dst").alias("to")), "levels-degree")
    chains = contract_chains(degree.where("remaining = 1").select("node", "to"))
    # dependencies of the nodes with several: to the end of a chain, longest way only; a null
    # or absent end never meets the frontier
    many = degree.where("remaining > 1").select("node", "remaining")
    ends = chains.select(F.col("node").alias("dst"), "anchor", "dist", F.lit(True).alias("chained"))
    links = stored(e.join(many.select(F.col("node").alias("src")), "src", "left_semi")
                   .join(ends, "dst", "left").select(
        "src", F.when(F.col("chained"), F.col("anchor")).otherwise(F.col("dst")).alias("dst"),
        (F.coalesce("dist", F.lit(0)) + 1).alias("dist")), "levels-links")
    held = stored(many.withColumn("level", F.lit(0).cast("long")), "levels-waiting")
    released = f"{ensure_checkpoint_dir(nodes.sparkSession)}/levels-{uuid.uuid4().hex}"
    spark, n = nodes.sparkSession, 0
    frontier = nodes.join(degree, "node", "left_anti").select(
        "node", F.lit(0).cast("long").alias("level"))
    schema = frontier.schema
    while True:
        frontier.write.parquet(f"{released}/round={n}")
        frontier = spark.read.schema(schema).parquet(f"{released}/round={n}")
        if n and frontier.isEmpty():
            break
        met = links.join(frontier.select(F.col("node").alias("dst"), F.col("level").alias("_l")),
                         "dst").groupBy(F.col("src").alias("node")).agg(
            F.count("*").alias("met"), F.max(F.col("_l") + F.col("dist")).alias("asks"))
        left = stored(held.where("remaining > 0").join(met, "node", "left").select(
            "node", (F.col("remaining") - F.coalesce("met", F.lit(0))).alias("remaining"),
            F.greatest("level", F.coalesce("asks", F.lit(0))).alias("level")), "levels-waiting")
        discard(held)
        held, n = left, n + 1
        frontier = held.where("remaining = 0").select("node", "level")
    anchors = spark.read.schema(schema).parquet(f"{released}/round=*")
    by_chain = chains.join(anchors.withColumnRenamed("node", "anchor"), "anchor").select(
        "node", (F.col("level") + F.col("dist")).alias("level"))
    done = anchors.unionByName(by_chain)
    return nodes.join(done, "node", "left").select(
        "node", F.col("level").cast("int").alias("level"), F.col("level").isNull().alias("cyclic"))


# ---------------------------------------------------------------- #45 ----
def declared_order(contracts: DataFrame, functions: DataFrame) -> DataFrame:
    """Contracts first, then functions in declared module order; with totals."""
    c = contracts.select("project_id", F.concat(F.lit("contract:"), "contract").alias("key"),
                         F.struct(F.lit(0).alias("k"), F.col("c_pos").alias("a"), F.lit(0).cast("int").alias("b")).alias("_ord"))
    f = functions.select("project_id", F.concat_ws(":", "module", "intent").alias("key"),
                         F.struct(F.lit(1).alias("k"), F.col("m_pos").alias("a"), F.col("f_pos").cast("int").alias("b")).alias("_ord"))
    u = running_sum(c.unionByName(f).withColumn("one", F.lit(1)), "project_id", ["_ord"], "one",
                    "position")
    totals = u.groupBy("project_id").agg(F.count("*").alias("total"))
    return join_on(u, totals, ["project_id"]).select("project_id", "key", "position", "total")


# ---------------------------------------------------------------- #38 ----
_LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def extract_dependencies(sections: DataFrame) -> DataFrame:
    """deps(req_id, attempt, pos, module, alias): one row per dependency line."""
    raw = T.py_strip(F.col("dependencies"))
    lines = sections.where(F.col("dependencies").isNotNull() & (raw != "")).select(
        "req_id", "attempt", F.posexplode(F.split(raw, _LINE_BREAK)).alias("pos", "line"))
    line = T.py_strip(F.col("line"))
    clean = T.py_strip(F.regexp_replace(line, ",+\\z", ""))
    kept = lines.where((line != "") & ~line.startswith("#")).withColumn("_c", clean).where(
        F.col("_c") != "")
    has_as = F.col("_c").contains(" as ")
    parts = F.split(F.col("_c"), " as ", 2)
    module = (F.when(has_as, T.py_strip(F.element_at(parts, 1)))
              .when(F.col("_c").startswith("- "), T.py_strip(F.substring(F.col("_c"), 3, 1 << 30)))
              .otherwise(F.col("_c")))
    alias = F.when(has_as, T.py_strip(F.element_at(parts, 2)))
    return kept.select("req_id", "attempt", F.col("pos").cast("int").alias("pos"),
                       module.alias("module"), alias.alias("alias"))


# ---------------------------------------------------------------- #39 ----
def import_statement(module: F.Column, alias: F.Column, language: F.Column) -> F.Column:
    return (F.when(language.isin("javascript", "typescript"),
                   F.when(alias.isNotNull(), F.format_string("import * as %s from '%s';", alias, module))
                   .otherwise(F.format_string("import %s from '%s';", module, module)))
            .when(language == "python",
                  F.when(alias.isNotNull(), F.format_string("import %s as %s", module, alias))
                  .otherwise(F.format_string("import %s", module)))
            .when(language == "go",
                  F.when(alias.isNotNull(), F.format_string('%s "%s"', alias, module))
                  .otherwise(F.format_string('"%s"', module))))


def render_imports(deps: DataFrame, languages: DataFrame) -> DataFrame:
    """statements(req_id, language, pos, statement), distinct per target file."""
    j = deps.join(languages, "req_id")
    return (j.select("req_id", "language", "pos",
                     import_statement(F.col("module"), F.col("alias"), F.col("language")).alias("statement"))
            .where(F.col("statement").isNotNull())
            .groupBy("req_id", "language", "statement").agg(F.min("pos").alias("pos")))


# ---------------------------------------------------------------- #40 ----
def dependency_usage(deps: DataFrame, k: int = 10) -> DataFrame:
    per = deps.select("req_id", "attempt", "module").distinct()
    return (per.groupBy("module").agg(F.count("*").alias("n_results"))
            .orderBy(F.desc("n_results"), "module").limit(k))


def dependency_cooccurrence(deps: DataFrame) -> DataFrame:
    """Module pairs used by the same result (pairs inside one reply's short list)."""
    per = deps.groupBy("req_id", "attempt").agg(F.array_sort(F.collect_set("module")).alias("ms"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size("ms"), F.lit(1))), lambda i:
                      F.transform(F.filter(F.sequence(i + 1, F.greatest(F.size("ms"), i + 1)),
                                           lambda j: j <= F.size("ms")),
                                  lambda j: F.struct(F.element_at("ms", i).alias("m1"),
                                                     F.element_at("ms", j).alias("m2")))))
    return (per.where(F.size("ms") >= 2).select(F.explode(pairs).alias("p"))
            .groupBy("p.m1", "p.m2").agg(F.count("*").alias("n")))
