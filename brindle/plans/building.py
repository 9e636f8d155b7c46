"""Dataset building over the driver's tables: records, curation, environments, tracks, features, graded logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import curating as C
from ..operators import features as E
from ..operators import logs as L
from ..operators import oracles as O
from ..operators import prompts as M
from ..operators import records as R
from ..operators import source_tree as S
from ..operators import tracks as K
from .registry import query

c, lit = F.col, F.lit


def text(*parts):
    """Parts end to end as text; names are columns where they are given as such."""
    return F.concat(*(p.cast("string") if not isinstance(p, str) else lit(p) for p in parts))


def choose(key, *values):
    """One of the values by the key's remainder."""
    out = F.when(key % len(values) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(key % len(values) == i, v)
    return out


# records --------------------------------------------------------------------------------------


@query("""SELECT CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment || '/' || c_name END AS full_name,
 CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END ELSE 'u' || c_custkey END AS owner,
 CASE WHEN c_custkey % 2 = 0 THEN 'n' ELSE CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END END AS repo,
 c_custkey AS stargazers_count, c_custkey % 4 <> 0 AS has_license, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AS n_topics, 'q' AS source_query FROM customer""")
def p1_repository_record(t):
    k = c("c_custkey")
    none = lit(None).cast("string")
    repos = t.customer.select(
        F.when(k % 5 != 0, text(c("c_mktsegment"), "/", c("c_name"))).alias("full_name"),
        F.when(k % 3 != 0, F.struct(text("u", k).alias("login"))).alias("owner"),
        F.when(k % 2 == 0, "n").alias("name"),
        F.struct(F.when(k % 4 != 0, "mit").alias("key"), none.alias("spdx_id"), none.alias("name")).alias("license"),
        F.when(k % 7 != 0, F.array(c("c_mktsegment"))).alias("topics"),
        k.alias("stargazers_count"),
    )
    out = R.repository_record(repos, "q", lit("now"))
    return out.select("full_name", "owner", "repo", "stargazers_count", c("license").isNotNull().alias("has_license"), F.size("topics").alias("n_topics"), "source_query")


def pulls(t):
    k = c("o_orderkey")
    return t.orders.select(
        text("acme/", F.lower("o_orderstatus")).alias("full_name"), k.alias("number"), F.when(k % 3 == 0, F.array().cast("array<int>")).when(k % 3 == 1, F.array((k % 10).cast("int"))).alias("resolved_issues"),
        F.when(k % 4 != 0, c("o_orderdate")).alias("merged_at"), F.md5(k.cast("string")).alias("base_sha"), F.when(k % 5 != 0, c("o_orderpriority")).alias("patch"), F.when(k % 2 == 0, "t").otherwise("").alias("test_patch"),
        F.when(k % 7 != 0, "p").otherwise("").alias("problem_statement"), lit("").alias("hints_text"), c("o_orderdate").alias("created_at"),
    )


@query("""SELECT 'acme__' || lower(o_orderstatus) || '-' || o_orderkey AS instance_id, 'acme/' || lower(o_orderstatus) AS repo, o_orderkey AS pull_number, md5(o_orderkey::VARCHAR) AS base_commit FROM orders""")
def p7_instances(t):
    return R.instances(pulls(t)).select("instance_id", "repo", "pull_number", "base_commit")


@query("SELECT o_orderkey AS number FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 3 = 1")
def f12_valid_pull(t):
    return pulls(t).where(R.valid_pull(c("merged_at"), c("resolved_issues"))).select("number")


@query("SELECT o_orderkey AS number FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def f13_valid_instance(t):
    return pulls(t).where(R.valid_instance(c("patch"), c("problem_statement"))).select("number")


@query("""SELECT count(*) AS pulls, count(*) FILTER (WHERE v) AS valid, count(*) FILTER (WHERE v AND k) AS complete, count(*) FILTER (WHERE v AND k AND o_orderkey % 2 = 0) AS tested
 FROM (SELECT o_orderkey, o_orderkey % 4 <> 0 AND o_orderkey % 3 = 1 AS v, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS k FROM orders)""")
def a22_build_counts(t):
    return R.build_counts(pulls(t), R.valid_pull(c("merged_at"), c("resolved_issues")), R.valid_instance(c("patch"), c("problem_statement")), c("test_patch") != "")


@query("SELECT o_orderkey::VARCHAR AS number, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE '' END AS patch, '' AS version FROM orders")
def p5_projected(t):
    return R.projected(pulls(t), ["number", "patch", "version"])


@query("""SELECT s_suppkey AS k, CASE WHEN s_nationkey < 5 THEN 'error' ELSE 'ok' END AS status, CASE WHEN s_nationkey < 5 THEN 'clone' END AS stage,
 CASE WHEN s_nationkey < 5 THEN 'nation ' || s_nationkey END AS message, CASE WHEN s_nationkey >= 5 THEN s_name END AS value FROM supplier""")
def p9_result_rows(t):
    message = F.when(c("s_nationkey") < 5, text("nation ", c("s_nationkey")))
    out = t.supplier.select(*R.result_row(c("s_suppkey").alias("k"), lit("clone"), message, c("s_name").alias("value")))
    return out.select("k", "status", "error.stage", "error.message", out.columns[3]).toDF("k", "status", "stage", "message", "value")


@query("""SELECT o_orderkey AS k, 'new' AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'own' END AS b, o_orderstatus AS s FROM orders""")
def x65_merged_maps(t):
    first = F.when(c("o_orderkey") % 2 == 0, F.create_map(lit("a"), lit("old"), lit("b"), lit("own")))
    m = R.merged_maps(first, F.create_map(lit("a"), lit("new"), lit("s"), c("o_orderstatus")))
    return t.orders.select(c("o_orderkey").alias("k"), m.alias("m")).select("k", *(c("m")[x].alias(x) for x in "abs"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE '{"type":"tool_call","id":"' || event_id || '"' || CASE WHEN event_type = 'error' THEN ',"error":"e"' ELSE '' END || '}' END AS action FROM events""")
def p11_tool_action(t):
    kind = F.when(c("event_type") == "view", "unknown").otherwise(" Tool_Call ")
    return t.events.select("event_id", R.tool_action(kind, id=c("event_id").cast("string"), name=lit(None).cast("string"), error=F.when(c("event_type") == "error", "e").otherwise("")).alias("action"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'in:name' ELSE 'in:topics,name' END AS q FROM orders")
def x5_in_qualifier(t):
    none = F.array().cast("array<string>")
    fields = choose(c("o_orderkey"), none, F.array(lit(" Name "), lit("")), F.array(lit("topics"), lit("NAME"), lit("Topics")))
    return t.orders.select(c("o_orderkey").alias("k"), R.in_qualifier(fields).alias("q"))


@query("""SELECT o_orderkey AS k, date_trunc('month', o_orderdate)::DATE AS first, last_day(o_orderdate)::DATE AS last, o_orderdate::DATE AS day FROM orders""")
def x42_date_boundary(t):
    month, day = F.date_format("o_orderdate", "yyyy-MM"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")
    return t.orders.select(c("o_orderkey").alias("k"), R.date_boundary(month).alias("first"), R.date_boundary(month, True).alias("last"), R.date_boundary(day, True).alias("day"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'soon' ELSE strftime(to_timestamp(event_id * 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') END AS at FROM events""")
def x44_epoch(t):
    value = F.when(c("event_id") % 3 == 0, "soon").otherwise((c("event_id") * 1000).cast("string"))
    return t.events.select("event_id", R.epoch_text(value).alias("at"))


@query("""SELECT o_custkey, o_orderkey FROM (
 SELECT *, min(CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN r END) OVER (PARTITION BY o_custkey) AS f FROM (
  SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders)) WHERE (f IS NULL OR r <= f) AND r <= 6""")
def x46_until_cutoff(t):
    return R.until_cutoff(t.orders, "o_orderdate", [F.desc("o_orderdate"), c("o_orderkey")], "19960101", 5, ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '1.' || p_size WHEN 1 THEN '2.3' END AS version, CASE WHEN p_partkey % 3 = 0 THEN '2021-01-02' END AS date FROM part""")
def x30_release_name(t):
    title = choose(c("p_partkey"), text("SQLFluff [1.", c("p_size"), ".4] - 2021-01-02"), lit("Version 2.3.9 of it"), lit("nothing"))
    return t.part.select("p_partkey", R.release_name(title).alias("r")).select("p_partkey", "r.*")


@query("""SELECT p_partkey, 'true' AS a, p_size::VARCHAR AS b, '"x' || p_size || '"' AS c, 'null' AS d, '0.5' AS e, '"it"' AS f FROM part""")
def x25_model_args(t):
    m = R.model_args(text("a=True,b=", c("p_size"), ",c=x", c("p_size"), ",d=None,e=0.5,f='it'"))
    return t.part.select("p_partkey", m.alias("m")).select("p_partkey", *(c("m")[x].alias(x) for x in "abcdef"))


@query("SELECT n_nationkey, n_name || ',second' AS names FROM nation")
def x31_environment_names(t):
    listing = text("# conda environments:\n#\nbase   /opt/base\n", c("n_name"), "   /opt/x\nsecond * /opt/y\n")
    return t.nation.select("n_nationkey", F.array_join(R.environment_names(listing), ",").alias("names"))


# curation -------------------------------------------------------------------------------------


def statements(t):
    k = c("o_orderkey")
    said = choose(k, lit("This fixes #12 at last"), text("see #", c("o_custkey")), lit("at https://gitlab.com/a/b/issues/3 it is"), lit("plain words"), lit("more at https://other.org/x and [img](a.png)"), lit("since 1a2b3c4d5 it breaks"))
    patch = choose(k, lit("diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1 +1 @@\n-x\n+y\n"), lit("diff --git a/n b/n\nnew file mode 100644\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+y\n"))
    tests = choose(k, lit("with pytest.raises(E, match='x'):"), lit("with pytest.raises(E):"), lit("self.assertRaises(E)"), lit("assert x"), lit(None).cast("string"))
    return t.orders.select(k.alias("k"), lit("acme/x").alias("repo"), said.alias("said"), patch.alias("patch"), tests.alias("tests"))


@query("""SELECT o_orderkey AS k, o_orderkey % 6 IN (0, 2) OR (o_orderkey % 6 = 1 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)) AS refers FROM orders""")
def f18_issue_references(t):
    issues = t.customer.where("c_nationkey < 10").select(lit("acme/x").alias("repo"), c("c_custkey").alias("number"))
    return C.issue_references(statements(t), "k", "repo", "said", issues).select("k", "refers")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 1")
def f19_changed_file_set(t):
    return statements(t).where(C.changes_file_set(c("patch"))).select("k")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 IN (0, 2)")
def f20_checked_messages(t):
    return statements(t).where(C.checks_messages(c("tests"))).select("k")


@query("SELECT o_orderkey AS k, o_orderkey % 6 IN (2, 4) AS links, o_orderkey % 6 = 4 AS media, o_orderkey % 6 = 5 AS hash FROM orders")
def f16_f17_links_media_hashes(t):
    return statements(t).select("k", C.foreign_links(c("said"), c("repo")).alias("links"), C.media_named(c("said")).alias("media"), C.commit_named(c("said")).alias("hash"))


@query("""SELECT position, stage, n_in, n_out FROM (SELECT count(*) AS c0, count(*) FILTER (WHERE k % 6 IN (1, 3)) AS c1, count(*) FILTER (WHERE k % 6 IN (1, 3) AND k % 2 = 0) AS c2 FROM (SELECT o_orderkey AS k FROM orders)),
 LATERAL (VALUES (0, 'problem_statement', c0, c1), (1, 'patch', c1, c2), (2, 'patch_test', c2, c2)) AS v(position, stage, n_in, n_out)""")
def f22_light_subset(t):
    s = statements(t)
    stages = C.lite_stages(c("said"), c("repo"), C.names_issue(c("said")), c("patch"), c("tests"), least_words=1)
    return C.light_subset(s, stages)[1]


REPLACED = [("types-pkg_resources", "types-setuptools"), ("yanked", None)]


@query(r"""SELECT p_partkey, 'numpy==' || p_size || chr(10) || 'types-setuptools' || chr(10) || 'yanked-not' AS clean FROM part""")
def x20_clean_requirements(t):
    raw = text("numpy==", c("p_size"), "\ntypes-pkg_resources>=1.", c("p_size"), "\nyanked==2\nyanked-not")
    return t.part.select("p_partkey", C.clean_requirements(raw, REPLACED).alias("clean"))


@query(r"""SELECT p_partkey, replace('name: mine|dependencies:|  - types-pkg_resources|  - pip:|    - numpy==' || p_size || '|    - types-setuptools|  - python', '|', chr(10)) AS clean FROM part""")
def x20_clean_environment(t):
    raw = text("name: x\ndependencies:\n  - types-pkg_resources\n  - pip:\n    - numpy==", c("p_size"), "\n    - types-pkg_resources==", c("p_size"), "\n    - yanked\n  - python")
    return t.part.select("p_partkey", C.clean_environment(C.rename_environment(raw, lit("mine")), REPLACED).alias("clean"))


@query("""SELECT n_nationkey AS key, 'req/all.txt' AS path, 'extra-' || n_nationkey || chr(10) || 'numpy' || chr(10) || n_name AS text FROM nation
 UNION ALL SELECT n_nationkey, 'req/base.txt', 'extra-' || n_nationkey FROM nation""")
def x21_requirement_texts(t):
    files = F.array(
        F.struct(lit("req/all.txt").alias("path"), text("# all\nnumpy\n-r base.txt\n-e .\n", c("n_name")).alias("text")),
        F.struct(lit("req/base.txt").alias("path"), text("extra-", c("n_nationkey"), "\n# no\n.[tests]").alias("text")),
    )
    return C.requirement_texts(t.nation.select(c("n_nationkey").alias("key"), F.inline(files)))


# tracks ---------------------------------------------------------------------------------------

def tracks(t):
    """A call and its result for each event, in nested JSON; errors fail, purchases say nothing."""
    k = c("event_id")
    said = F.when(c("event_type") == "error", ',"status":"failed"').when(c("event_type") == "purchase", "").otherwise(',"exit_code":0')
    responses = text('[{"response":{"output":[{"type":"tool_call","call_id":"', k, '","name":"', c("event_type"), '","arguments":{"b":1,"a":"src/F', k % 7, '.ts"}}]}},{"response":{"type":"tool_result","call_id":"', k, '"', said, ',"output":"done"}}]')
    metadata = text('{"target":{"abstract_node":{"path":"SRC\\\\f', k % 5, '.ts"}},"mask":{"path":"src/x.ts"},"reference_implementation_files":["src/F', k % 7, '.ts","done"]}')
    return t.events.select(k.alias("track_id"), responses.alias("responses"), metadata.alias("task_metadata"))


@query("""SELECT event_id AS track_id, 6::BIGINT AS objects, CASE WHEN event_type = 'error' THEN 8 ELSE 7 END::BIGINT AS strings FROM events""")
def x60_deep_walk(t):
    n = K.nodes(tracks(t), "track_id", "responses")
    return n.groupBy("track_id").agg(F.count_if(c("kind") == "object").alias("objects"), F.count_if(c("kind") == "string").alias("strings"))


@query("""SELECT event_id AS track_id, 'tool_call' AS type, event_id::VARCHAR AS action_id, event_type AS tool, event_type || ':{"a":"src/F' || (event_id % 7) || '.ts","b":1}' AS signature,
 CASE WHEN event_type = 'error' THEN false WHEN event_type <> 'purchase' THEN true END AS success, 'done' AS detail FROM events""")
def x61_actions(t):
    found = K.nodes(tracks(t), "track_id", "responses")
    return K.actions(found, ["track_id"]).select("track_id", "type", "action_id", "tool", "signature", "success", "detail")


@query("""SELECT event_id AS track_id, 'SRC/f' || (event_id % 5) || '.ts|src/x.ts|src/F' || (event_id % 7) || '.ts|done' AS files FROM events""")
def x63_expected_files(t):
    return tracks(t).select("track_id", F.array_join(K.expected_files(c("task_metadata"))["all"], "|").alias("files"))


@query("""SELECT event_id AS track_id, 2 AS rounds, 1::BIGINT AS total, (event_type <> 'purchase')::BIGINT AS known, (event_type NOT IN ('purchase', 'error'))::BIGINT AS succeeded,
 4::BIGINT AS expected, (2 + (event_id % 5 = event_id % 7)::INT)::BIGINT AS recalled FROM events""")
def s19_evaluated_tracks(t):
    return K.evaluate(tracks(t)).select("track_id", "rounds", "total", "known", "succeeded", "expected", "recalled")


@query("""SELECT event_id, NOT coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS accepted FROM events""")
def t4_closed_runs(t):
    state = F.when(c("event_type") == "purchase", "completed").otherwise("recording")
    return K.closed_runs(t.events.select("event_id", "user_id", state.alias("state")), ["user_id"], "event_id", "state").select("event_id", "accepted")


# features -------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'false' WHEN 2 THEN 'true' WHEN 3 THEN '""' WHEN 4 THEN '0' WHEN 5 THEN '[]' WHEN 6 THEN 'null' ELSE '""' END AS wrong FROM lineitem""")
def x13_wrong_value(t):
    n = c("l_linenumber")
    signature = F.when(n == 3, "f(a: number): string {").when(n == 5, "g(): Array<Item> {").otherwise("h() {")
    expression = F.when(n == 1, "a >= b").when(n == 2, "false").when(n == 4, "items.length").when(n == 6, "this.make()").when(n == 7, "base.message;").otherwise("x")
    return t.lineitem.select("l_orderkey", n, E.wrong_value(signature, expression).alias("wrong"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'assignment' WHEN 2 THEN 'condition' WHEN 3 THEN 'return' WHEN 4 THEN 'argument' WHEN 5 THEN 'promise_chain' END AS use FROM lineitem""")
def x14_consumption(t):
    n = c("l_linenumber")
    prefix = F.when(n == 1, "  const x: Foo = await ").when(n == 2, "if (a && ").when(n == 3, " return await ").when(n == 4, "run(").otherwise("  ")
    return t.lineitem.select("l_orderkey", n, E.consumption(prefix, F.when(n == 5, "f().then(g)").otherwise("f()")).alias("use"))


def sources(t):
    """A small tree of four files for each part."""
    k = c("p_partkey")
    base = text("export interface Shape", k, " {\n  area(): number\n}\nexport abstract class Base {\n  size(): number {\n    return this.items.length;\n  }\n}\n")
    one = text("import { Shape", k, " as S, Base } from './shapes'\nexport class One extends Base implements S {\n  ok(): boolean {\n    // return no\n    return false;\n  }\n}\n")
    two = text("import { Shape", k, " } from './shapes'\nfunction use(s: Shape", k, "): Shape", k, " {\n  return s;\n}\n")
    other = text("import { Shape", k, " } from './nowhere'\nclass Other implements Shape", k, " {\n}\n")
    files = F.array(*(F.struct(text(k, f"/{n}.ts").alias("path"), v.alias("source")) for n, v in (("shapes", base), ("one", one), ("two", two), ("other", other))))
    return t.part.select(F.inline(files))


def masked_lines(files):
    rows = files.select("path", F.posexplode(F.split("source", "\n")).alias("n", "text"))
    return rows.select("path", (c("n") + 1).alias("line"), "text", F.regexp_replace("text", "//.*$", "").alias("masked"))


@query("""SELECT p_partkey || '/' || f AS path, q AS qualified, l AS line, o AS original, m AS mutated FROM part, (VALUES
 ('shapes.ts', 'Base.size', 6, '    return this.items.length;', '    return 0;'), ('one.ts', 'One.ok', 5, '    return false;', '    return true;'), ('two.ts', 'use', 3, '  return s;', '  return null;')) AS v(f, q, l, o, m)""")
def g6_return_mutations(t):
    files = sources(t)
    functions = S.parse(files, "nodes").where(c("type").isin("function", "method"))
    return E.return_mutations(functions, masked_lines(files))


def found_implementers(t):
    files = sources(t)
    nodes, imports = S.parse(files, "nodes"), S.parse(files, "imports")
    bound = S.bindings(S.resolve(imports, files))
    abstract = E.abstract_nodes(nodes)
    return files, nodes, abstract, E.implementers(abstract, bound, files.select("path", c("source").alias("masked")))


@query("""SELECT p_partkey || '/shapes.ts' AS target, CASE WHEN n = 'Base' THEN n ELSE 'Shape' || p_partkey END AS name, p_partkey || '/' || f AS path, r AS relation, CASE WHEN f = 'two.ts' THEN 'Shape' || p_partkey ELSE l END AS local
 FROM part, (VALUES ('Shape', 'one.ts', 'explicit_inheritance', 'S'), ('Base', 'one.ts', 'explicit_inheritance', 'Base'), ('Shape', 'two.ts', 'structural_usage', '')) AS v(n, f, r, l)""")
def j14_implementers(t):
    return found_implementers(t)[3]


@query("""SELECT p_partkey || '/shapes.ts' AS target, 'Shape' || p_partkey AS name, 2::BIGINT AS implementations, p_partkey || '/one.ts,' || p_partkey || '/two.ts' AS paths FROM part""")
def g10_feature_candidates(t):
    _, _, abstract, found = found_implementers(t)
    return E.feature_candidates(found, abstract).select("target", "name", "implementations", F.array_join("paths", ",").alias("paths"))


@query("""SELECT p_partkey AS instance_id, p_partkey % 2 = 0 AS masked_file_changed, p_partkey % 3 <> 0 AS expected_declarations_restored, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AS passed, p_partkey % 2 = 1 AS matches_gold FROM part""")
def g13_verified_instances(t):
    files, nodes, abstract, found = found_implementers(t)
    k = c("p_partkey")
    one = files.where(c("path").endswith("/one.ts")).select(F.substring_index("path", "/", 1).cast("long").alias("p_partkey"), F.sha2("source", 256).alias("now"))
    instances = t.part.select("p_partkey").join(S.shuffled(one), "p_partkey").select(
        k.alias("instance_id"), text(k, "/shapes.ts").alias("target"), lit("class").alias("node_type"), lit("Base").alias("name"), text(k, "/one.ts").alias("masked_path"),
        F.when(k % 3 != 0, F.array(lit("One"))).otherwise(F.array(lit("One"), lit("Gone"))).alias("declarations"),
        F.when(k % 2 == 0, "old").otherwise(c("now")).alias("masked_sha256"), F.when(k % 2 == 1, c("now")).otherwise("gold").alias("original_sha256"),
    )
    out = E.verify(instances, abstract, found, E.declarations(nodes), files)
    return out.select("instance_id", "masked_file_changed", "expected_declarations_restored", "passed", "matches_gold")


@query("""SELECT l_orderkey AS k, count(*) FILTER (WHERE l_returnflag = 'R') = 1 AND count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'N') = 0 AS passed
 FROM lineitem GROUP BY 1""")
def g17_verified_lines(t):
    lines = t.lineitem.select(c("l_orderkey").alias("k"), text(F.when(c("l_returnflag") == "R", "R").otherwise(text(c("l_returnflag"), c("l_linestatus")))).alias("text"))
    keys = t.lineitem.select(c("l_orderkey").alias("k")).distinct()
    return E.verify_lines(keys.select("k", lit("R").alias("text")), keys.select("k", lit("NO").alias("text")), lines, "k")


@query("""SELECT p_partkey, 'id:string:false,size' || p_size || ':number[]:true' AS fields, 'Color=RED+GREEN' AS enums, 'Side=''L''|''R''' AS aliases, p_size::VARCHAR AS entry FROM part""")
def x26_declared_parts(t):
    source = text("export interface Shape {\n  id: string;\n  // no: x\n  size", c("p_size"), "?: number[]\n  run() { a: 1 }\n}\nexport enum Color {\n  RED = 1, GREEN,\n}\nexport type Side = 'L'|'R';\nexport const MAP: Record<string, number> = {\n  'a': ", c("p_size"), ",\n}\n")
    field = F.transform(O.interface_fields(c("source"), lit("Shape")), lambda f: F.concat_ws(":", f["name"], f["type"], f["optional"].cast("string")))
    enum = F.transform(O.enums(c("source")), lambda e: F.concat(e["name"], lit("="), F.array_join(e["members"], "+")))
    alias = F.transform(O.aliases(c("source")), lambda a: F.concat_ws("=", a["name"], a["type"]))
    entry = F.get(O.const_objects(c("source")), lit(0))["entries"]["a"]
    return t.part.select("p_partkey", source.alias("source")).select("p_partkey", F.array_join(field, ",").alias("fields"), F.array_join(enum, ",").alias("enums"), F.array_join(alias, ",").alias("aliases"), entry.alias("entry"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '''LEFT''' WHEN 2 THEN '''sample''' WHEN 3 THEN '1' WHEN 4 THEN '[]' WHEN 5 THEN 'Color.RED' WHEN 6 THEN 'undefined' END AS value FROM lineitem""")
def x27_sample_value(t):
    n = c("l_linenumber")
    kind = F.when(n == 1, "Side | 'LEFT'").when(n == 2, "string | number").when(n == 3, "number").when(n == 4, "Foo[]").when(n == 5, "Color").otherwise("Foo")
    known = O.enums(lit("export enum Color { RED, GREEN }"))
    return t.lineitem.select("l_orderkey", n, O.sample_value(kind, n == 6, known).alias("value"))


# texts for models -----------------------------------------------------------------------------


@query("""SELECT n_nationkey || '.py' AS path, n_nationkey || '.py' || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'About ' || n_name || chr(10) || chr(10) || 'f' || chr(10) || 'Does it.' ELSE 'def (' || n_name END AS encoded FROM nation""")
def r1_documented(t):
    source = choose(c("n_nationkey"), text('"""About ', c("n_name"), '"""\ndef f():\n    "Does it."\ndef g():\n    pass\n'), text("def (", c("n_name")))
    return M.path_and_documentation(t.nation.select(text(c("n_nationkey"), ".py").alias("path"), source.alias("text")))


def contexts(t):
    """An instance a supplier with a patch of two files, and the files of each nation's repository."""
    nation = c("s_nationkey")
    patch = text("diff --git a/b.py b/b.py\n@@\ndiff --git a/", F.when(c("s_suppkey") % 3 == 0, "gone.py").otherwise("a.py"), " b/a.py\n")
    instances = t.supplier.select(c("s_suppkey").alias("instance_id"), text("r", nation).alias("repo"), lit("c").alias("commit"), patch.alias("patch"))
    files = t.nation.select(text("r", c("n_nationkey")).alias("repo"), lit("c").alias("commit"), F.explode(F.array(lit("a.py"), lit("b.py"))).alias("path"), c("n_name").alias("text"))
    return instances, files


BLOCK = "'[start of {0}.py]' || chr(10) || n_name || chr(10) || '[end of {0}.py]'"


@query(f"""SELECT s_suppkey AS instance_id, 2::BIGINT AS n_files, CASE WHEN s_suppkey % 3 <> 0 THEN {BLOCK.format("b")} || chr(10) || {BLOCK.format("a")} END AS context FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def r7_oracle_context(t):
    instances, files = contexts(t)
    return M.text_inputs(instances, "oracle", files)


@query(f"""SELECT s_suppkey AS instance_id, 2::BIGINT AS n_files, {BLOCK.format("a")} || chr(10) || {BLOCK.format("b")} AS context FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def r7_whole_context(t):
    instances, files = contexts(t)
    return M.text_inputs(instances, "all", files)


@query("""SELECT s_suppkey AS instance_id, (s_suppkey % 2)::BIGINT AS n_files FROM supplier""")
def r7_retrieved_context(t):
    instances, files = contexts(t)
    hits = instances.where("instance_id % 2 = 1").select("instance_id", F.posexplode(F.array(lit("b.py"), lit("a.py"))).alias("rank", "path")).withColumn("rank", c("rank") + 1)
    return M.text_inputs(instances, "bm25", files, hits, 1).select("instance_id", "n_files")


@query("""SELECT doc_id, len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_ \\t\\n\\r\\f\\x0b]'))::INT AS n FROM documents""")
def r8_token_counts(t):
    return t.documents.select("doc_id", M.n_tokens(c("text")).alias("n"))


@query("""SELECT o_custkey, count(*) AS days, min(lo)::DATE AS first, max(lo)::DATE AS last FROM (
 SELECT o_custkey, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS lo FROM (SELECT o_custkey, min(o_orderdate)::DATE AS a, least(max(o_orderdate)::DATE, min(o_orderdate)::DATE + 40) AS b FROM orders GROUP BY 1)) GROUP BY 1""")
def x41_day_slices(t):
    ends = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b")).withColumn("b", F.least("b", F.date_add("a", 40)))
    s = ends.select("o_custkey", F.inline(X.date_slices(c("a"), c("b"), "day")))
    return s.groupBy("o_custkey").agg(F.count(lit(1)).alias("days"), F.min("lo").alias("first"), F.max("hi").alias("last"))


@query("""SELECT o_custkey, greatest(y::DATE, a) AS lo, least(make_date(year(y), 12, 31), b) AS hi FROM (SELECT o_custkey, a, b, unnest(generate_series(date_trunc('year', a), b, INTERVAL 1 YEAR)) AS y FROM (
 SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1))""")
def x41_year_slices(t):
    ends = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return ends.select("o_custkey", F.inline(X.date_slices(c("a"), c("b"), "year")))


# graded logs ----------------------------------------------------------------------------------


def evaluations(t):
    """A log an order: between the marks, without them, with a bad code, or with all outside them."""
    body = text("PASS: t", c("o_orderkey"), "\nFAIL: other\n")
    mark = lambda x: text(L.START, "\n", x, L.END, "\n")
    log = choose(c("o_orderkey"), mark(body), body, text(L.BAD_CODES[0], "\n", mark(body)), text(body, mark(lit("nothing\n"))), lit(None).cast("string"))
    return t.orders.select(c("o_orderkey").cast("string").alias("instance_id"), log.alias("log"))


@query("SELECT o_orderkey::VARCHAR AS instance_id, o_orderkey % 5 IN (0, 3) AS applied FROM orders")
def f28_gradable(t):
    return L.gradable(evaluations(t)).select("instance_id", "applied")


@query("""SELECT o_orderkey::VARCHAR AS instance_id, test, status FROM (SELECT o_orderkey, 't' || o_orderkey AS test, 'PASSED' AS status FROM orders UNION ALL SELECT o_orderkey, 'other', 'FAILED' FROM orders) WHERE o_orderkey % 5 IN (0, 3)""")
def l7_graded_logs(t):
    return L.parse_evaluations(evaluations(t), "jq")


@query("""SELECT o_orderkey::VARCHAR AS instance_id, CASE WHEN o_orderkey % 3 = 2 THEN 'T' || o_orderkey ELSE 't' || o_orderkey END AS test, CASE WHEN o_orderkey % 3 = 2 THEN 'SKIPPED' ELSE 'PASSED' END AS status FROM orders""")
def l6_mixed_logs(t):
    k = c("o_orderkey")
    log = choose(k, text("PASS: t", k), text("PASSED t", k), text("--- SKIP: T", k, " (0.1s)"))
    return L.parse_mixed(t.orders.select(k.cast("string").alias("instance_id"), choose(k, lit("jq"), lit("flask"), lit("gotest")).alias("project"), log.alias("log")), projects=["jq", "flask", "gotest"])


REPORTS = {
    "cucumber": ("features/a{k} ....\nfeatures/b ..F", [("features/a{k}", "PASSED"), ("features/b", "FAILED")]),
    "marked": ("1) first {k} \n x", [("first {k}", "FAILED")]),
    "matplotlib": ("PASSED t{k}[MouseButton.LEFT]", [("t{k}[1]", "PASSED")]),
    "calypso": ("x ./node_modules/.bin/jest run\n  suite {k}\n    inner\n      ✓ works (3ms)\n    next\n      ✕ fails\nTest Suites: 1", [("suite {k} - inner - works", "PASSED"), ("suite {k} - next - fails", "FAILED")]),
    "karma": ("x\nStarting browser Chrome\n  outer\n    in{k}\n      ✔ yes\n      ✖ no\nSUMMARY:\n ✔ 1", [("outer > in{k} > yes", "PASSED"), ("outer > in{k} > no", "FAILED")]),
    "chart_js": ("Chrome 99.0 (Linux x) a{k} FAILED\nChrome 99.0 (Linux x) fine", [("a{k} ", "FAILED")]),
    "p5js": ("noise {{\n 9) hidden:\n}}\n  1) top{k}\n       inner:\n <b>7) x:</b>", [("top{k}:inner", "FAILED")]),
    "doctest": ('<doctest><TestCase name="A{k}"><SubCase name="s"><Expression success="true"/></SubCase><SubCase name="t"><Expression success="false"/></SubCase></TestCase></doctest>', [("A{k} > s", "PASSED"), ("A{k} > t", "FAILED")]),
}


def _report_query(parser: str, log: str, rows: list[tuple[str, str]]):
    quoted = lambda x: "'" + x.replace("'", "''").replace("{k}", "' || n_nationkey || '") + "'"
    sql = " UNION ALL ".join(f"SELECT n_nationkey::VARCHAR AS instance_id, {quoted(name)} AS test, '{status}' AS status FROM nation" for name, status in rows)

    def run(t):
        shown = F.replace(lit(log.replace("{{", "{").replace("}}", "}")), lit("{k}"), c("n_nationkey").cast("string"))
        return L.parse(t.nation.select(c("n_nationkey").cast("string").alias("instance_id"), shown.alias("log")), parser)

    run.__name__ = f"l_{parser}"
    return query(sql)(run)


for _parser, (_log, _rows) in REPORTS.items():
    _report_query(_parser, _log, _rows)
