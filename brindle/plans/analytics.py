"""Aggregates, scalar functions, retrieval, logs, patches and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import grading as G
from ..operators import logs as L
from ..operators import patches as D
from ..operators import retrieval as R
from ..operators import upsert as U
from ..operators import windowing as W
from .registry import query

c = F.col


@query("""SELECT o_orderpriority AS key2, o_orderstatus AS "key", count(*) AS n FROM orders GROUP BY 1, 2""")
def a1_map_sum(t):
    per = t.orders.groupBy("o_custkey", "o_orderpriority", "o_orderstatus").count()
    maps = per.groupBy("o_custkey", "o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "count"))).alias("m"))
    return G.merge_counts(maps, "m", ["o_orderpriority"]).withColumnRenamed("o_orderpriority", "key2")


@query("""SELECT user_id, count(*) AS n, max(value) AS most, bool_or(event_type = 'error') AS any_error, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS views FROM events GROUP BY 1""")
def a4_run_totals(t):
    kind = c("event_type")
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"), F.bool_or(kind == "error").alias("any_error"), F.count_if(kind == "view").alias("views"))


@query("""SELECT count(DISTINCT l_orderkey) AS files, count(*) AS calls, count(*) FILTER (WHERE l_returnflag = 'R') AS hits FROM lineitem""")
def a7_scan_report(t):
    return t.lineitem.agg(F.count_distinct("l_orderkey").alias("files"), F.count(F.lit(1)).alias("calls"), F.count_if(c("l_returnflag") == "R").alias("hits"))


@query("""SELECT doc_id, len(list_distinct([w FOR w IN regexp_extract_all(lower(text), '[a-z]+') IF w NOT IN ('the', 'of', 'and')]))::BIGINT AS out_degree FROM documents""")
def a8_out_degree(t):
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return t.documents.select("doc_id", F.size(F.array_distinct(F.filter(ws, lambda w: ~w.isin("the", "of", "and")))).cast("long").alias("out_degree"))


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS downstream FROM lineitem GROUP BY 1")
def a9_downstream(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("downstream"))


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first FROM orders GROUP BY 1")
def a10_first_per_key(t):
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("first"))


ACTIONS = """SELECT user_id, CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false WHEN 'view' THEN value > 30 END AS success FROM events"""


@query(f"""SELECT user_id, count(*) AS total, count(success) AS known, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE NOT success) AS failed,
 round(count(success) / count(*)::DOUBLE, 6) AS coverage, round(count(*) FILTER (WHERE success) / nullif(count(success), 0)::DOUBLE, 6) AS success_rate FROM ({ACTIONS}) GROUP BY 1""")
def a11_action_validity(t):
    kind = c("event_type")
    ok = F.when(kind == "purchase", True).when(kind == "error", False).when(kind == "view", c("value") > 30)
    m = G.action_metrics(t.events.select("user_id", ok.alias("success")), ["user_id"])
    return m.withColumns({"coverage": F.round("coverage", 6), "success_rate": F.round("success_rate", 6)})


@query("SELECT conv_id, count(*) AS n, count(DISTINCT role) AS rounds, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY 1")
def a12_rounds(t):
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("role").alias("rounds"), F.min("turn").alias("first"), F.max("turn").alias("last"))


@query("""SELECT o_custkey, round(len(list_intersect(f, g)) / nullif(len(list_distinct(g)), 0)::DOUBLE, 6) AS recall FROM (
 SELECT o_custkey, coalesce(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'O'), []) AS f, list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS g FROM orders GROUP BY 1)""")
def a13_recall(t):
    take = lambda s: F.collect_list(F.when(c("o_orderstatus") == s, c("o_orderpriority")))
    return t.orders.groupBy("o_custkey").agg(F.round(G.recall(take("O"), take("F")), 6).alias("recall"))


GRADED = """SELECT e.k, e.category, coalesce(s.status IN ('PASSED', 'XFAIL'), false) AS ok, e.test FROM (
  SELECT DISTINCT l_orderkey AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'F2P' ELSE 'P2P' END AS category, l_linenumber AS test FROM lineitem) e
 LEFT JOIN (SELECT l_orderkey AS k, l_linenumber AS test, CASE WHEN max(l_returnflag) = 'R' THEN 'FAILED' WHEN max(l_returnflag) = 'N' THEN 'PASSED' ELSE 'XFAIL' END AS status FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2) s
 ON e.k = s.k AND e.test = s.test"""


def graded(t):
    expected = t.lineitem.select(c("l_orderkey").alias("k"), F.when(c("l_linenumber") % 2 == 0, "F2P").otherwise("P2P").alias("category"), c("l_linenumber").alias("test")).distinct()
    flag = F.max("l_returnflag")
    statuses = t.lineitem.where("l_quantity > 10").groupBy(c("l_orderkey").alias("k"), c("l_linenumber").alias("test")).agg(F.when(flag == "R", "FAILED").when(flag == "N", "PASSED").otherwise("XFAIL").alias("status"))
    return G.grade(expected, statuses, ["k", "test"])


@query(f"""SELECT k, category, coalesce(string_agg(test, ',' ORDER BY test) FILTER (WHERE ok), '') AS success, coalesce(string_agg(test, ',' ORDER BY test) FILTER (WHERE NOT ok), '') AS failure FROM ({GRADED}) GROUP BY 1, 2""")
def a14_grading(t):
    text = lambda x: F.array_join(c(x).cast("array<string>"), ",").alias(x)
    return graded(t).select("k", "category", text("success"), text("failure"))


@query(f"""SELECT k, CASE WHEN f = 1 AND p = 1 THEN 'FULL' WHEN f > 0 AND f < 1 AND p = 1 THEN 'PARTIAL' ELSE 'NO' END AS resolution FROM (
 SELECT k, coalesce(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) FILTER (WHERE category = 'F2P'), 1) AS f, coalesce(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) FILTER (WHERE category = 'P2P'), 1) AS p FROM ({GRADED}) GROUP BY 1)""")
def a16_resolution(t):
    n = lambda k, x: F.coalesce(F.max(F.when(c("category") == k, F.size(x))), F.lit(0))
    g = graded(t).groupBy("k").agg(G.share(n("F2P", "success"), n("F2P", "failure")).alias("f"), G.share(n("P2P", "success"), n("P2P", "failure")).alias("p"))
    return g.select("k", G.resolution(c("f"), c("p")).alias("resolution"))


OUTCOME = """CASE WHEN o_orderkey % 7 = 0 THEN 'incomplete' WHEN o_orderpriority = '5-LOW' THEN 'empty_patch' WHEN o_orderstatus = 'P' OR o_orderkey % 11 = 0 THEN 'error'
 WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'unresolved' END"""


def outcomes(t):
    k = c("o_orderkey")
    data = t.orders.select(k.alias("instance_id"), "o_orderstatus", "o_orderpriority")
    patch = F.when(c("o_orderpriority") != "5-LOW", c("o_orderpriority"))
    predictions = data.where("instance_id % 7 <> 0").select("instance_id", patch.alias("patch")).union(data.select(-1 - c("instance_id"), F.lit("p")))
    # one run in eleven ended in an error, and partly shipped orders have no report at all
    reports = data.where("o_orderstatus <> 'P'").select("instance_id", F.when(c("instance_id") % 11 != 0, c("o_orderstatus") == "F").alias("resolved"))
    return G.run_outcomes(data, predictions, reports)


@query(f"SELECT o_orderkey AS instance_id, {OUTCOME} AS outcome FROM orders")
def a17_run_outcomes(t):
    return outcomes(t)


@query(f"""SELECT count(*) AS total_instances, count(*) FILTER (WHERE o <> 'incomplete') AS submitted_instances, count(*) FILTER (WHERE o IN ('resolved', 'unresolved')) AS completed_instances,
 count(*) FILTER (WHERE o = 'resolved') AS resolved_instances, count(*) FILTER (WHERE o = 'unresolved') AS unresolved_instances, count(*) FILTER (WHERE o = 'empty_patch') AS empty_patch_instances,
 count(*) FILTER (WHERE o = 'error') AS error_instances, count(*) FILTER (WHERE o = 'incomplete') AS incomplete_instances, 2::BIGINT AS schema_version FROM (SELECT {OUTCOME} AS o FROM orders)""")
def a17_run_report(t):
    return G.run_report(outcomes(t))


@query("""SELECT count(*) AS n, round(avg(r) * 100, 6) AS avg_recall, round(avg((r = 1)::INT) * 100, 6) AS all_recall, round(avg((r > 0)::INT) * 100, 6) AS any_recall FROM (
 SELECT g.k, count(h.i) / count(*)::DOUBLE AS r FROM (SELECT DISTINCT l_orderkey AS k, l_partkey AS i FROM lineitem WHERE l_quantity > 20) g
 LEFT JOIN (SELECT DISTINCT l_orderkey AS k, l_partkey AS i FROM lineitem WHERE l_discount > 0.04) h ON g.k = h.k AND g.i = h.i GROUP BY 1)""")
def a19_retrieval_recall(t):
    pick = lambda w: t.lineitem.where(w).select(c("l_orderkey").alias("k"), c("l_partkey").alias("i"))
    return R.recall_report(pick("l_discount > 0.04"), pick("l_quantity > 20"), "k", "i")


@query("SELECT p_brand, string_agg(p_partkey, ',' ORDER BY p_partkey) AS parts FROM part GROUP BY 1")
def a20_group_collect(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_partkey")).cast("array<string>"), ",").alias("parts"))


@query("SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM orders GROUP BY 1")
def a21_latest(t):
    return t.orders.groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("latest"))


@query("""SELECT event_type, round(sum(value * CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 ELSE 1.0 END), 3) AS cost FROM events GROUP BY 1""")
def a24_cost(t):
    prices = t.spark.createDataFrame([("click", 0.5), ("view", 0.25)], "event_type string, price double")
    priced = t.events.join(prices, "event_type", "left").withColumn("price", F.coalesce("price", F.lit(1.0)))
    return priced.groupBy("event_type").agg(F.round(F.sum(c("value") * c("price")), 3).alias("cost"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def a25_build_keys(t):
    return t.part.select("p_brand", "p_type").distinct()


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(quantile_cont(o_totalprice, 0.95), 4) AS p95,
 count(*) FILTER (WHERE o_totalprice >= 100000) AS many FROM orders GROUP BY 1""")
def a26_quantiles(t):
    q = W.quantiles(t.orders, ["o_orderpriority"], "o_totalprice", {"p75": 0.75, "p90": 0.9, "p95": 0.95})
    many = t.orders.groupBy("o_orderpriority").agg(F.count_if(c("o_totalprice") >= 100000).alias("many"))
    return q.select("o_orderpriority", *(F.round(p, 4).alias(p) for p in ("p75", "p90", "p95"))).join(many, "o_orderpriority")


# scalar functions -----------------------------------------------------------------------------


@query("""SELECT p_partkey, regexp_replace(p_brand, '#', '/') AS repo, split_part(p_name, ' ', 1) AS head,
 replace(regexp_replace(p_brand, '#', '/') || '-' || p_size, '/', '__') AS instance_id, array_to_string(string_split('1.' || p_size || '.7', '.')[1:2], '.') AS version FROM part""")
def x2_names(t):
    repo = F.regexp_replace("p_brand", "#", "/")
    version = X.major_minor(F.concat(F.lit("1."), c("p_size").cast("string"), F.lit(".7")))
    return t.part.select("p_partkey", repo.alias("repo"), F.substring_index("p_name", " ", 1).alias("head"), X.instance_id(repo, c("p_size")).alias("instance_id"), version.alias("version"))


@query("""SELECT p_partkey, concat_ws(' ', CASE WHEN p_name LIKE '% %' THEN '"' || p_name || '"' ELSE p_name END, 'in:name',
 CASE WHEN p_size > 20 THEN 'stars:' || p_size || '..' || (p_size + 10) ELSE 'stars:>=' || p_size END, CASE WHEN p_type <> 'PROMO' THEN 'language:' || p_type END) AS q FROM part""")
def x6_search_query(t):
    high = F.when(c("p_size") > 20, c("p_size") + 10)
    language = F.when(c("p_type") != "PROMO", F.concat(F.lit("language:"), c("p_type")))
    return t.part.select("p_partkey", X.search_query(X.quote_term(c("p_name")), F.lit("in:name"), X.range_qualifier("stars", c("p_size"), high), language).alias("q"))


@query("""SELECT doc_id, regexp_replace(coalesce(nullif(regexp_extract(text, 'Version ([0-9.]+)', 1), ''), nullif(regexp_extract(text, 'version ([0-9]+)', 1), ''), ''), '[^0-9.]', '', 'g') AS version FROM documents""")
def x16_version_in_text(t):
    found = [F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in ("Version ([0-9.]+)", "version ([0-9]+)")]
    return t.documents.select("doc_id", F.regexp_replace(F.coalesce(*found, F.lit("")), "[^0-9.]", "").alias("version"))


@query("SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_custkey::VARCHAR, o_orderkey::VARCHAR])), ',') AS issues FROM orders")
def x17_resolved_issues(t):
    s = lambda x: c(x).cast("string")
    text = F.concat(F.lit("Fixes #"), s("o_custkey"), F.lit(" and closes  #"), s("o_orderkey"), F.lit(" but see #7 <!-- resolves #1 -->, resolved #"), s("o_custkey"))
    return t.orders.select("o_orderkey", F.array_join(X.resolved_issues(text), ",").alias("issues"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS diff FROM orders")
def x18_first_diff(t):
    text = F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("text <diff>"), c("o_orderstatus"), F.lit("</diff> <patch>no</patch>"))).otherwise(F.concat(F.lit("x ```diff\n"), c("o_orderpriority"), F.lit("``` y")))
    return t.orders.select("o_orderkey", X.first_diff(text).alias("diff"))


@query("SELECT c_custkey, c_name AS plain FROM customer")
def x19_strip_ansi(t):
    return t.customer.select("c_custkey", X.strip_ansi(F.concat(F.lit("\x1b[31m"), F.left("c_name", F.lit(4)), F.lit("\x1b[0;1m"), F.expr("substring(c_name, 5)"))).alias("plain"))


@query("""SELECT doc_id, array_to_string([i || ' ' || l FOR l, i IN string_split(text, chr(10))], chr(10)) AS numbered FROM documents""")
def x22_number_lines(t):
    return t.documents.select("doc_id", X.number_lines(c("text")).alias("numbered"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page FROM pages")
def x24_url_parts(t):
    return t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "[?&]page=([0-9]+)", 1).alias("page"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS iso FROM orders""")
def x40_dates(t):
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return t.orders.select("o_orderkey", X.date_prefix(iso).alias("day"), F.last_day("o_orderdate").cast("string").alias("month_end"), F.date_format(X.parse_time(iso), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("""SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE date_trunc('day', o_orderdate) END, '%Y%m%d') AS day FROM orders""")
def x45_any_format(t):
    shown = F.when(c("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd MMM yyyy")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return t.orders.select("o_orderkey", F.date_format(X.any_format(shown, "dd MMM yyyy", "yyyy/MM/dd"), "yyyyMMdd").alias("day"))


@query("SELECT p_partkey, round(p_size / nullif(p_size % 3, 0)::DOUBLE, 6) AS r, greatest(1, least(p_size, 30)) AS clamped FROM part")
def x50_ratio_and_clamp(t):
    return t.part.select("p_partkey", F.round(X.ratio(c("p_size"), c("p_size") % 3), 6).alias("r"), F.greatest(F.lit(1), F.least("p_size", F.lit(30))).alias("clamped"))


@query("SELECT doc_id, sha256(text) AS full, substring(sha256(lang || chr(10) || source), 1, 10) AS short FROM documents")
def x52_hashes(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("full"), X.short_key(c("lang"), c("source")).alias("short"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN true WHEN event_type = 'error' THEN false WHEN value < 5 THEN false WHEN event_type = 'view' THEN true END AS ok FROM events""")
def x62_outcome(t):
    kind, none = c("event_type"), F.lit(None)
    success = F.when(kind == "purchase", True)
    is_error = F.when(kind == "error", True)
    status = F.when(c("value") < 5, "failed").when(kind == "view", "ok").otherwise("pending")
    return t.events.select("event_id", G.outcome(success, is_error, none.cast("int"), status, none.cast("string")).alias("ok"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def x64_json_field(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT conv_id, turn, array_to_string(list_concat([-100 FOR x IN range(greatest(length(role) - 1, 0))], [turn, turn + 1]), ',') AS labels FROM conversations""")
def x66_labels(t):
    masked = F.concat(F.array_repeat(F.lit(-100).cast("long"), F.length("role") - 1), F.array(c("turn"), c("turn") + 1))
    return t.conversations.select("conv_id", "turn", F.array_join(masked.cast("array<string>"), ",").alias("labels"))


@query("""SELECT c_custkey, '{"c_acctbal":' || c_acctbal || ',"c_custkey":' || c_custkey || ',"c_mktsegment":' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS doc FROM customer""")
def s16_canonical_json(t):
    df = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), "c_acctbal")
    return df.select("c_custkey", U.canonical_json(df).alias("doc"))


@query("""SELECT s_suppkey AS k, coalesce(n.v, s_acctbal) AS v, s_suppkey AS place FROM supplier LEFT JOIN (SELECT 2 * c_custkey AS k, c_acctbal AS v FROM customer) n ON s_suppkey = n.k
UNION ALL SELECT 2 * c_custkey, c_acctbal, c_custkey + (SELECT max(s_suppkey) + 1 FROM supplier) FROM customer WHERE 2 * c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def s14_upsert(t):
    old = t.supplier.select(c("s_suppkey").alias("k"), c("s_acctbal").alias("v"), c("s_suppkey").alias("place"))
    new = t.customer.select((2 * c("c_custkey")).alias("k"), c("c_acctbal").alias("v"), c("c_custkey").alias("place"))
    return U.upsert(old, new, "k")


# retrieval and packing --------------------------------------------------------------------------

TOKENS = "[w FOR w IN regexp_split_to_array(lower(text), '[^a-z0-9]+') IF w <> '']"


@query(f"""WITH d AS (SELECT doc_id, {TOKENS} AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d),
q AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
r AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * len / mean))), 6) AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY 1, 2)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 20""")
def r3_bm25(t):
    return R.search(t.benchmark.select("item_id", c("text").alias("q")), t.documents, "item_id", c("q"), "doc_id", c("text"))


@query("""SELECT conv_id, kept.used AS used, array_to_string(kept.ids, ',') AS turns FROM (SELECT conv_id, list_reduce(list_concat([{used: 0::BIGINT, ids: []::BIGINT[], n: 0::BIGINT, t: 0::BIGINT}], list({used: 0::BIGINT, ids: []::BIGINT[], n: length(text)::BIGINT, t: turn} ORDER BY turn)),
 lambda a, x: CASE WHEN a.used + x.n < 900 THEN {used: a.used + x.n, ids: list_append(a.ids, x.t), n: 0::BIGINT, t: 0::BIGINT} ELSE a END) AS kept FROM conversations GROUP BY 1)""")
def r6_greedy_packing(t):
    items = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("items"))
    packed = items.select("conv_id", X.pack_fold(c("items"), lambda x: x["n"], 900).alias("p"))
    return packed.select("conv_id", c("p.used").alias("used"), F.array_join(F.transform("p.kept", lambda x: x["turn"].cast("string")), ",").alias("turns"))


@query("""SELECT doc_id, len(w) >= 100 AND len(list_distinct(w[-100:])) <= 10 AS repeating FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def r9_repeating(t):
    return t.documents.select("doc_id", R.repeating(F.split("text", " ")).alias("repeating"))


# logs: a log a supplier is written out of its line items and parsed back -------------------------

STATUS = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END"


def logs_of(t, form):
    """(instance_id, log): a line for each line item, in the order of its keys."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    g = t.lineitem.groupBy(c("l_suppkey").alias("instance_id")).agg(F.array_sort(F.collect_list(key)).alias("xs"))
    return g.select("instance_id", F.array_join(F.transform("xs", form), "\n").alias("log"))


def flag(x, *words):
    return F.element_at(F.array(*map(F.lit, words)), F.when(x["l_returnflag"] == "A", 1).when(x["l_returnflag"] == "R", 2).otherwise(3))


def test_name(x):
    return F.concat(F.lit("t"), (x["l_orderkey"] % 50).cast("string"))


def last_sql(*words):
    listed = ", ".join(f"'{w}'" if w else "NULL" for w in words)
    return f"""SELECT instance_id, test, status FROM (SELECT l_suppkey AS instance_id, 't' || l_orderkey % 50 AS test, ([{listed}])[{STATUS} + 1] AS status,
 l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem) WHERE status IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY instance_id, test ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC, l_returnflag DESC) = 1"""


THREE = ("PASSED", "FAILED", "SKIPPED")
TWO = ("PASSED", "FAILED", None)


def spell(*parts):
    return lambda x: F.concat(*(p(x) if callable(p) else F.lit(p) for p in parts))


FORMS = {
    "redis": (spell("[", lambda x: flag(x, "ok", "err", "skip"), "]: ", test_name, " (12 ms)"), THREE),
    "jq": (spell("  ", lambda x: flag(x, "PASS", "FAIL", "SKIP"), ": ", test_name), TWO),
    "micropython": (spell(lambda x: flag(x, "pass", "FAIL", "skip"), "  ", test_name), THREE),
    "googletest": (spell("[  ", lambda x: flag(x, "OK", "FAILED", "RUN"), " ] ", test_name, " (0 ms)"), TWO),
    "gotest": (spell("--- ", lambda x: flag(x, "PASS", "FAIL", "SKIP"), ": ", test_name, " (0.01s)"), THREE),
    "ant": (spell("  [junit] [", lambda x: flag(x, "PASS", "ERR", "NONE"), "] ", test_name), TWO),
    "jest": (spell("    ", lambda x: flag(x, "✓", "✕", "○"), " ", test_name, " (3 ms)"), THREE),
    "jest_json": (spell("[", lambda x: flag(x, "PASSED", "FAILED", "PENDING"), "] ", test_name), TWO),
    "vitest": (spell(" ", lambda x: flag(x, "✓", "×", "↓"), " ", test_name, " 5ms"), THREE),
    "tap": (spell(lambda x: flag(x, "ok", "not ok", "#"), " 7 ", test_name), TWO),
    "react_pdf": (spell(lambda x: flag(x, "PASS", "FAIL", "RUNS"), " ", test_name, " (1.5s)"), TWO),
    "minitest": (spell(test_name, ". Class#x = 0.01 s = ", lambda x: flag(x, ".", "F", "E")), ("PASSED", "FAILED", "FAILED")),
    "ruby_unit": (spell("test: ", test_name, ":\t", lambda x: flag(x, ".", "F", "O"), ": (0.1)"), THREE),
    "rspec": (spell(test_name, " - ", lambda x: flag(x, "passed", "failed", "pending")), TWO),
    "cargo": (spell("test ", test_name, " ... ", lambda x: flag(x, "ok", "FAILED", "ignored")), TWO),
    "pytest": (spell(lambda x: flag(x, "PASSED", "FAILED", "SKIPPED"), " ", test_name, " - text"), THREE),
    "pytest_options": (spell(lambda x: flag(x, "PASSED", "FAILED", "XFAIL"), " ", test_name), ("PASSED", "FAILED", "XFAIL")),
    "pytest_v2": (spell(test_name, " [32m", lambda x: flag(x, "PASSED", "FAILED", "ERROR")), ("PASSED", "FAILED", "ERROR")),
    "seaborn": (spell(test_name, " ", lambda x: flag(x, "PASSED", "PASSED", "none"), " [ 5%]"), ("PASSED", "PASSED", None)),
    "sympy": (spell("test_", test_name, " ", lambda x: flag(x, "ok", "F", "E")), ("PASSED", "FAILED", "ERROR")),
    "django": (spell(test_name, " ... ", lambda x: flag(x, "ok", "FAIL", "skipped 'why'")), THREE),
    "gradle": (spell(test_name, " > m\n", lambda x: flag(x, "PASSED", "FAILED", "note")), TWO),
    "phpunit": (spell("Suite (x)\n ", lambda x: flag(x, "✔", "✘", "↩"), " ", test_name), THREE),
    "maven": (spell("+ mvn test -Dtest=", test_name, "\n", lambda x: flag(x, "BUILD SUCCESS", "BUILD FAILURE", "BUILD FAILURE")), ("PASSED", "FAILED", "FAILED")),
}


def _register_logs():
    for name, (form, words) in FORMS.items():
        test = {"sympy": "'test_' || test", "gradle": "test || ' > m'", "phpunit": "'Suite > ' || test"}.get(name, "test")

        def run(t, name=name, form=form):
            return L.parse(logs_of(t, form), name)

        run.__name__ = f"l_{name}"
        query(f"SELECT instance_id, {test} AS test, status FROM ({last_sql(*words)})")(run)


_register_logs()


# patches: a diff an order is written out of its line items and parsed back -----------------------


def diffs(t):
    """(k, patch): a file a line item with one hunk of some added and removed lines."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    part = lambda x: F.concat(
        F.lit("diff --git a/src/"), F.when(x["l_linenumber"] == 3, "test_").otherwise("f"), x["l_partkey"].cast("string"), F.lit(" b/src/x\n--- a/src/f"), x["l_partkey"].cast("string"), F.lit("\n+++ b/src/f\n@@ -10,"),
        (x["l_linenumber"] + 1).cast("string"), F.lit(" +10,"), (F.floor(x["l_quantity"]) + 1).cast("string"), F.lit(" @@\n same\n"), F.repeat(F.lit("-- old\n"), x["l_linenumber"]), F.repeat(F.lit("+new\n"), F.floor(x["l_quantity"]).cast("int")),
    )
    g = t.lineitem.groupBy(c("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(key)).alias("xs"))
    return g.select("k", F.array_join(F.transform("xs", part), "").alias("patch"))


@query("""SELECT l_orderkey AS k, count(*) AS hunks, sum(floor(l_quantity))::BIGINT AS added, sum(l_linenumber)::BIGINT AS removed, count(*) AS context FROM lineitem GROUP BY 1""")
def d1_hunks(t):
    h = D.hunks(diffs(t), "k", "patch")
    return h.groupBy("k").agg(F.count(F.lit(1)).alias("hunks"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum("context").alias("context"))


@query("""SELECT l_orderkey AS k, count(*) FILTER (WHERE l_linenumber <> 3) AS fix, count(*) FILTER (WHERE l_linenumber = 3) AS test FROM lineitem GROUP BY 1""")
def d2_split_tests(t):
    s = diffs(t).select("k", D.split_tests(c("patch")).alias("s"))
    n = lambda x: F.size(D.file_parts(c(x))).cast("long")
    return s.select("k", n("s.fix").alias("fix"), n("s.test").alias("test"))


@query("""SELECT l_orderkey AS k, string_agg('src/f' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS files FROM lineitem GROUP BY 1""")
def d6_touched(t):
    return diffs(t).select("k", F.array_join(D.touched(c("patch")), ",").alias("files"))


# streams ------------------------------------------------------------------------------------------


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS place FROM events GROUP BY 1")
def t1_stream_upsert(t):
    """Events arrive in micro-batches; each user's row keeps its place and takes the latest values."""
    import uuid

    from ..operators.joining import settle
    from ..streaming.flows import upsert_stream

    settle(t.spark.range(1))  # makes sure that a shared folder is set
    base = t.spark.sparkContext._jsc.sc().getCheckpointDir().get() + f"/upsert-{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir).select("user_id", "event_id", "event_type", c("event_id").alias("place"))
    upsert_stream(stream, f"{base}/table", "user_id", f"{base}/state").awaitTermination()
    from ..sources.jsonl import current_version

    return t.spark.read.parquet(f"{base}/table/v{current_version(t.spark, base + '/table')}").select("user_id", "event_id", "event_type", "place")
