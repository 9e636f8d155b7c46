"""Filters, joins, windows, sorts and sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import filtering as P
from ..operators import joining as J
from ..operators import windowing as W
from .registry import query

c = F.col


def order_rules() -> list[P.Rule]:
    return [
        P.Rule("archived", c("o_orderstatus") == "F"),
        *P.bounds(c("o_totalprice"), "price_below_min", "price_above_max", 20000, 400000),
        *P.date_bounds(c("o_orderdate"), "date_out_of_range", "1996-01-01", "1999-12-31"),
        *P.member(c("o_orderpriority"), ["1-urgent", " 2-HIGH", "3-medium "], "priority_not_listed"),
    ]


REASONS = """concat_ws(',',
  CASE WHEN o_orderstatus = 'F' THEN 'archived' END,
  CASE WHEN coalesce(o_totalprice, 0) < 20000 THEN 'price_below_min' END,
  CASE WHEN coalesce(o_totalprice, 0) > 400000 THEN 'price_above_max' END,
  CASE WHEN o_orderdate IS NULL OR o_orderdate < TIMESTAMP '1996-01-01' THEN 'date_out_of_range' END,
  CASE WHEN o_orderdate IS NULL OR o_orderdate > TIMESTAMP '1999-12-31' THEN 'date_out_of_range' END,
  CASE WHEN lower(trim(o_orderpriority)) NOT IN ('1-urgent', '2-high', '3-medium') THEN 'priority_not_listed' END)"""


@query(f"SELECT o_orderkey, {REASONS} AS reasons FROM orders")
def f1_rejection_reasons(t):
    return t.orders.select("o_orderkey", F.array_join(P.reasons(order_rules()), ",").alias("reasons"))


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {REASONS} = ''")
def f2_explainable_filter(t):
    return P.keep(t.orders, order_rules()).select("o_orderkey", "o_totalprice")


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split({REASONS}, ',')) AS reason FROM orders) WHERE reason <> '' GROUP BY reason")
def a3_rejection_counts(t):
    return P.reject_counts(t.orders, order_rules())


@query("""SELECT unnest([0, 1]) AS position, unnest(['price', 'date']) AS stage, unnest([n0, n1]) AS n_in, unnest([n1, n2]) AS n_out
FROM (SELECT count(*) AS n0, count(*) FILTER (WHERE o_totalprice > 100000) AS n1,
      count(*) FILTER (WHERE o_totalprice > 100000 AND o_orderdate >= TIMESTAMP '1997-01-01') AS n2 FROM orders)""")
def f7_staged_counts(t):
    _, counts = P.staged(t.orders, [("price", c("o_totalprice") > 100000), ("date", c("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))])
    return counts.withColumn("position", c("position").cast("int"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT'")
def f7_staged_survivors(t):
    return P.staged(t.orders, [("price", c("o_totalprice") > 100000), ("priority", c("o_orderpriority") == "1-URGENT")])[0].select("o_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_type = '' OR p_type IS NULL THEN CASE WHEN p_brand = '' OR p_brand IS NULL THEN coalesce(p_name, '') ELSE p_brand END
ELSE CASE WHEN p_type = 'PROMO' THEN p_brand ELSE p_type END END AS label FROM part""")
def f6_first_filled(t):
    return t.part.select("p_partkey", P.first_filled(F.when(c("p_type") != "PROMO", c("p_type")).otherwise(""), c("p_brand"), c("p_name")).alias("label"))


CONFIDENCE = """CASE WHEN main AND markers >= 2 THEN 'high' WHEN (main AND markers >= 1 AND kw) OR (markers >= 3 AND kw) THEN 'medium'
 WHEN main AND kw THEN 'low' ELSE 'none' END"""


def user_evidence(t):
    kind = c("event_type")
    e = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    marks = F.size(F.array_compact(F.array(*(F.when(F.bool_or(kind == k), k) for k in ("click", "view", "signup")))))
    g = e.groupBy("user_id", "day").agg(F.bool_or(kind == "purchase").alias("main"), marks.cast("long").alias("markers"), (F.max("value") > 60).alias("kw"))
    return g.withColumn("confidence", P.confidence(c("main"), c("markers"), c("kw")))


EVIDENCE = f"""SELECT user_id, day, markers, {CONFIDENCE} AS confidence FROM (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, bool_or(event_type = 'purchase') AS main,
    (bool_or(event_type = 'click')::INT + bool_or(event_type = 'view')::INT + bool_or(event_type = 'signup')::INT)::BIGINT AS markers,
    max(value) > 60 AS kw FROM events GROUP BY 1, 2)"""


@query(EVIDENCE)
def f9_confidence(t):
    return user_evidence(t).select("user_id", "day", "markers", "confidence")


@query(f"SELECT confidence, count(*) AS n, list_position(['none','low','medium','high'], confidence)::BIGINT - 1 AS rank FROM ({EVIDENCE}) GROUP BY confidence")
def a5_confidence_histogram(t):
    return user_evidence(t).groupBy("confidence").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", P.level_rank(c("confidence")))


@query("""SELECT doc_id, array_to_string([k FOR k IN ['idiot', 'license', 'the ', '@', 'token'] IF contains(lower(text), k)], ',') AS found FROM documents""")
def f11_keywords(t):
    return t.documents.select("doc_id", F.array_join(P.keywords_in(c("text"), ["idiot", "license", "the ", "@", "token"]), ",").alias("found"))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '(^|/)fr/') OR url LIKE '%/index.html' OR url = 'index.html'")
def f10_path_predicates(t):
    return t.pages.where(c("url").rlike("(^|/)fr/") | P.path_is(c("url"), "index.html")).select("page_id")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def f14_filled(t):
    return t.conversations.where((c("role") == "user") & (F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r")) != "")).select("conv_id", "turn")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^0-9A-Za-z/])[0-9a-f]{40}($|[^0-9A-Za-z])')")
def f15_commit_hash(t):
    return t.documents.where(c("text").rlike("(^|[^0-9A-Za-z/])[0-9a-f]{40}($|[^0-9A-Za-z])")).select("doc_id")


@query("SELECT page_id FROM pages WHERE regexp_matches(html, 'https?://') AND NOT regexp_matches(html, 'https?://[a-z]+[.]example[.]com')")
def f16_foreign_links(t):
    return t.pages.where(c("html").rlike("https?://") & ~c("html").rlike("https?://[a-z]+[.]example[.]com")).select("page_id")


@query("SELECT page_id FROM pages WHERE regexp_matches(html, '(?i)[.](png|jpg|jpeg|gif|webp|svg|bmp|ico|mp4|webm|mov)([^0-9A-Za-z_]|$)')")
def f17_media(t):
    return t.pages.where(c("html").rlike(r"(?i)[.](png|jpg|jpeg|gif|webp|svg|bmp|ico|mp4|webm|mov)([^0-9A-Za-z_]|$)")).select("page_id")


@query("SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\r\\n\\x0b\\x0c]+'))::BIGINT AS n FROM documents WHERE len(regexp_extract_all(text, '[^ \\t\\r\\n\\x0b\\x0c]+')) BETWEEN 40 AND 200")
def f21_word_limit(t):
    n = F.size(P.words(c("text")))
    return t.documents.where(P.at_most(n, 200, 40)).select("doc_id", n.cast("long").alias("n"))


@query("SELECT doc_id FROM documents WHERE length(text) <= 1000")
def f23_length_limit(t):
    return t.documents.where(F.length("text") <= 1000).select("doc_id")


@query("SELECT page_id FROM pages WHERE list_has_any(regexp_split_to_array(lower(url), '[ _/.?=&]+'), ['fr', 'page', 'test'])")
def f24_token_set(t):
    return t.pages.where(P.has_tokens(c("url"), ["fr", "page", "test"], "[ _/.?=&]+")).select("page_id")


@query("SELECT doc_id FROM documents WHERE len([x FOR x IN string_split(lower(text), chr(10)) IF contains(x, 'license') AND contains(x, 'under')]) > 0")
def f25_line_holds(t):
    return t.documents.where(P.line_holds_all(c("text"), "license", "under")).select("doc_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '5%' THEN true
 WHEN o_orderstatus = 'P' AND o_totalprice < 1000 THEN true ELSE false END AS remove FROM orders""")
def f26_rule_table(t):
    s = c("o_orderstatus")
    remove = F.when(s == "F", True).when((s == "O") & c("o_orderpriority").startswith("5"), True).when((s == "P") & (c("o_totalprice") < 1000), True).otherwise(False)
    return t.orders.select("o_orderkey", remove.alias("remove"))


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def f27_to_build(t):
    done = t.orders.where("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey"))
    return t.customer.where("c_mktsegment = 'BUILDING'").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT p_partkey, regexp_matches(p_name, '^[a-z]+ [a-z]+$') AS ok FROM part")
def f29_whitelist(t):
    return t.part.select("p_partkey", c("p_name").rlike("^[a-z]+ [a-z]+$").alias("ok"))


@query("""SELECT page_id, array_to_string([x FOR x IN regexp_extract_all(html, 'href="([^"]*)"', 1) IF NOT ends_with(x, '.css') AND NOT ends_with(x, ',')], ' ') AS links FROM pages""")
def f30_directives(t):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return t.pages.select("page_id", F.array_join(F.filter(found, lambda x: ~x.endswith(".css") & ~x.endswith(",")), " ").alias("links"))


# joins --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j1_inner(t):
    o = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    return o.select("o_orderkey", "c_name", "n_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def j2_semi(t):
    return t.orders.join(t.customer.where("c_acctbal > 5000"), c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def j2_missing(t):
    return J.missing(t.orders.select(c("o_custkey").alias("c_custkey")), t.customer.where("c_acctbal > 5000"), ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def j3_pending(t):
    results = t.orders.select(c("o_custkey").alias("c_custkey"), "o_orderstatus")
    return J.pending(t.customer.select("c_custkey"), results, ["c_custkey"], c("o_orderstatus") == "O")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j4_anti(t):
    return t.part.join(t.lineitem.where("l_quantity > 45").select(c("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9500)")
def j5_contamination(t):
    held = t.customer.where("c_mktsegment = 'MACHINERY' AND c_acctbal > 9500").select(c("c_nationkey").alias("s_nationkey"))
    return t.supplier.join(held, "s_nationkey", "left_anti").select("s_suppkey")


@query("""SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id < d.doc_id)""")
def j6_whole_text(t):
    # texts meet by hash and are compared whole only where hashes agree; min() is combined before the shuffle
    first = t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    return first.select("doc_id")


@query("""SELECT c_custkey, coalesce(hits, '') AS hits FROM customer LEFT JOIN (
 SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY n) AS hits FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3 GROUP BY 1) ON o_custkey = c_custkey""")
def j7_left_outer_top(t):
    hits = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    out = J.top_hits(t.customer.select("c_custkey"), hits, "c_custkey", 3, c("o_orderkey"), [F.desc("o_totalprice"), c("o_orderkey")])
    return out.select("c_custkey", F.array_join(c("hits").cast("array<string>"), ",").alias("hits"))


@query("""SELECT l_partkey, p_partkey FROM (
 SELECT l_partkey, p_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY rank) AS n FROM (
  SELECT l_partkey, unnest([l_partkey * 3, l_partkey + 1900, l_partkey * 2, l_partkey]) AS p_partkey, unnest([0, 1, 2, 3]) AS rank FROM (SELECT DISTINCT l_partkey FROM lineitem))
 WHERE p_partkey IN (SELECT p_partkey FROM part)) WHERE n = 1""")
def j8_first_candidate(t):
    k = c("l_partkey")
    return J.first_candidate(t.lineitem.select("l_partkey").distinct(), t.part, F.array(k * 3, k + 1900, k * 2, k), "p_partkey", ["l_partkey"])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, p_partkey // 3 AS b FROM part WHERE p_partkey > 0),
 w AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part WHERE p_size = 7
 UNION SELECT root, b, depth + 1 FROM w JOIN e ON node = a)
SELECT root, node, min(depth)::BIGINT AS depth FROM w GROUP BY 1, 2""")
def j9_closure(t):
    edges = t.part.where("p_partkey > 0").select(c("p_partkey").alias("a"), F.expr("p_partkey div 3").alias("b"))
    return J.closure(edges, "a", "b", t.part.where("p_size = 7").select("p_partkey"))


@query("""SELECT DISTINCT a.doc_id AS a, b.conv_id AS b FROM documents a JOIN conversations b ON a.doc_id = b.conv_id
WHERE regexp_matches(b.text, '(^|[^A-Za-z])' || regexp_extract(a.text, '[A-Za-z]{2,}') || '([^A-Za-z]|$)') AND regexp_extract(a.text, '[A-Za-z]{2,}') <> ''""")
def j10_equi_and_pattern(t):
    word = F.regexp_extract("d.text", "[A-Za-z]{2,}", 0)
    j = t.documents.alias("d").join(t.conversations.alias("v"), c("d.doc_id") == c("v.conv_id"))
    hit = F.regexp_like("v.text", F.concat(F.lit("(^|[^A-Za-z])"), word, F.lit("([^A-Za-z]|$)")))
    return j.where((word != "") & hit).select(c("doc_id").alias("a"), c("conv_id").alias("b")).distinct()


INTERVALS = """SELECT l_orderkey AS k, l_linenumber AS id, l_quantity::BIGINT AS a, l_quantity::BIGINT + 1 + l_partkey % 9 AS b FROM lineitem"""


def intervals(t):
    q = c("l_quantity").cast("long")
    return t.lineitem.select(c("l_orderkey").alias("k"), c("l_linenumber").cast("long").alias("id"), q.alias("a"), (q + 1 + c("l_partkey") % 9).alias("b"))


@query(f"""WITH i AS (SELECT k, a, b, min(id) AS id FROM ({INTERVALS}) GROUP BY 1, 2, 3), p AS (SELECT o_orderkey AS k, (floor(o_totalprice)::BIGINT % 50) AS x FROM orders)
SELECT p.k, p.x, i.id::BIGINT AS id FROM p LEFT JOIN i ON p.k = i.k AND x BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY p.k, p.x ORDER BY b - a, -a, i.id) = 1""")
def j11_innermost(t):
    points = t.orders.select(c("o_orderkey").alias("k"), F.pmod(F.floor("o_totalprice").cast("long"), F.lit(50)).alias("x"))
    spans = intervals(t).groupBy("k", "a", "b").agg(F.min("id").alias("id"))
    return J.innermost(points, spans, ["k"], "x", "a", "b", ["id"])


@query("""SELECT DISTINCT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN lineitem m ON l.l_orderkey = m.l_orderkey
WHERE m.l_shipdate > l.l_shipdate AND m.l_shipdate <= l.l_shipdate + INTERVAL 20 DAY AND m.l_returnflag = 'R'""")
def j13_range_semi(t):
    later = t.lineitem.where("l_returnflag = 'R'").select(c("l_orderkey").alias("k"), c("l_shipdate").alias("later"))
    near = (c("l_orderkey") == c("k")) & (c("later") > c("l_shipdate")) & (c("later") <= c("l_shipdate") + F.expr("interval 20 day"))
    return t.lineitem.join(later, near, "left_semi").select("l_orderkey", "l_linenumber").distinct()


@query("""WITH s AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
q AS (SELECT o_orderkey AS k, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'O')
SELECT q.k, s.o_orderkey AS previous FROM q ASOF LEFT JOIN s ON q.o_custkey = s.o_custkey AND q.o_orderdate > s.o_orderdate""")
def j15_asof(t):
    known = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    asked = t.orders.where("o_orderstatus = 'O'").select(c("o_orderkey").alias("k"), "o_custkey", "o_orderdate")
    return J.asof(asked, known, "o_orderdate", "o_orderdate", ["o_custkey"], {"o_orderkey": "previous"}).select("k", "previous")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def j16_containment(t):
    return J.contains_any(t.documents, t.benchmark.select("item_id", c("text").alias("needle")), "doc_id", "text", "item_id", "needle")


@query("""SELECT o_orderkey, coalesce(max(l_returnflag), 'FAILED') AS status FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 40 GROUP BY 1""")
def j17_missing_is_failed(t):
    seen = t.lineitem.where("l_quantity > 40").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.max("l_returnflag").alias("status"))
    return t.orders.select("o_orderkey").join(seen, "o_orderkey", "left").withColumn("status", F.coalesce("status", F.lit("FAILED")))


@query("""SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def j18_small_side(t):
    s = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    return s.select("s_suppkey", "n_name", "r_name")


@query("""SELECT event_id FROM (SELECT event_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stop FROM events) WHERE stop = 0""")
def j19_take_while(t):
    return J.take_while(t.events, ["user_id"], ["ts", "event_id"], c("event_type") != "error").select("event_id")


@query("""SELECT kw || ' created:' || lo || '..' || hi AS q, lo FROM (SELECT unnest(['ring', 'widget']) AS kw),
(SELECT strftime(greatest(m, DATE '2024-01-15'), '%Y-%m-%d') AS lo, strftime(least(last_day(m), DATE '2024-05-03'), '%Y-%m-%d') AS hi
 FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-05-01', INTERVAL 1 MONTH))::DATE AS m))""")
def j20_planned_queries(t):
    kws = F.explode(F.array(F.lit("ring"), F.lit("widget"))).alias("kw")
    slices = F.explode(X.month_slices(F.lit("2024-01-15").cast("date"), F.lit("2024-05-03").cast("date"))).alias("s")
    plan = t.spark.range(1).select(slices).select("s.*", kws)
    return plan.select(X.search_query(c("kw"), X.range_qualifier("created", c("lo"), c("hi"))).alias("q"), c("lo").cast("string").alias("lo"))


@query("""SELECT user_id, start, event_id AS "end" FROM (SELECT user_id, event_id, event_type,
 last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM events) WHERE event_type = 'purchase'""")
def j21_start_complete(t):
    return J.pair_starts(t.events, ["user_id"], "event_id", c("event_type") == "view", c("event_type") == "purchase")


@query("""WITH a AS (SELECT user_id, event_id AS test, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, event_id AS result, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events WHERE event_type = 'purchase')
SELECT user_id, pos::BIGINT AS pos, test, result FROM a JOIN b USING (user_id, pos)""")
def j22_positional(t):
    a = t.events.where("event_type = 'click'").select("user_id", c("event_id").alias("test"))
    b = t.events.where("event_type = 'purchase'").select("user_id", c("event_id").alias("result"))
    return J.positional(a, b, ["user_id"], ["test"], ["result"]).select("user_id", c("pos").cast("long").alias("pos"), "test", "result")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')")
def j23_semi_then_sum(t):
    picked = t.customer.where("c_mktsegment = 'FURNITURE'").select(c("c_custkey").alias("o_custkey"))
    return t.orders.join(picked, "o_custkey", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# windows ------------------------------------------------------------------------------------


@query("SELECT o_orderkey, ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS chunk FROM orders")
def w1_chunks(t):
    return W.chunks(t.orders, ["o_orderstatus"], ["o_orderkey"], 7).select("o_orderkey", "chunk")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS chunk FROM orders) WHERE chunk = 2")
def w2_contiguous_shard(t):
    return W.chunks(t.orders, ["o_orderpriority"], ["o_orderkey"], 4).where("chunk = 2").select("o_orderkey")


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 4 AS shard FROM orders")
def w3_strided_shard(t):
    return W.strided(t.orders, ["o_orderpriority"], ["o_orderkey"], 4).select("o_orderkey", "shard")


@query("""SELECT event_id, round(spent, 4) AS spent FROM (SELECT event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent - value < 200""")
def w4_until_spent(t):
    return W.until_spent(t.events, ["user_id"], ["event_id"], c("value"), 200).select("event_id", F.round("spent", 4).alias("spent"))


@query("""SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM conversations""")
def w5_offsets(t):
    return W.offsets(t.conversations, ["conv_id"], ["turn"], F.length("text").cast("long")).select("conv_id", "turn", "offset")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS suite FROM events""")
def w6_forward_fill(t):
    return W.carry(t.events, ["user_id"], ["event_id"], F.when(c("event_type") == "signup", c("event_id")), "suite").select("event_id", "suite")


@query("""SELECT event_id, name FROM (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER w = 'click' THEN lag(event_id) OVER w END AS name FROM events
WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'purchase' AND name IS NOT NULL""")
def w7_pending_name(t):
    out = W.after_marker(t.events, ["user_id"], ["event_id"], c("event_type") == "click", c("event_type") == "purchase", c("event_id"), "name")
    return out.select("event_id", "name")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def w9_sequence(t):
    return W.sequence(t.events, ["user_id"], ["ts", "event_id"]).select("event_id", "seq")


@query("""SELECT min(event_id) AS place, user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def w10_latest_in_first_place(t):
    return W.latest_in_first_place(t.events.select("event_id", "user_id", "event_type"), "user_id", "event_id")


@query("SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS rank FROM supplier")
def w12_rank(t):
    return W.sequence(t.supplier, ["s_nationkey"], [F.desc("s_acctbal"), "s_suppkey"], "rank", 0).select("s_suppkey", "rank")


@query("""SELECT event_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM events""")
def w13_depth(t):
    is_ = lambda k: F.when(c("event_type") == k, 1).otherwise(0)
    return W.depth(t.events, ["user_id"], ["event_id"], is_("signup"), is_("purchase")).select("event_id", "depth")


# sort, top-k, samples -------------------------------------------------------------------------


@query("SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_size DESC, p_name, p_partkey LIMIT 1")
def o1_best(t):
    return t.part.orderBy(F.desc("p_retailprice"), F.desc("p_size"), "p_name", "p_partkey").limit(1).select("p_partkey")


@query("SELECT o_custkey, arg_min(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END) * 100000000 + o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def o3_min_by(t):
    rank = F.struct(F.when(c("o_orderstatus") == "F", 0).otherwise(1), c("o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", rank).alias("o_orderkey"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS place FROM conversations")
def o4_by_length(t):
    return W.sequence(t.conversations, ["conv_id"], [F.length("text"), "turn"], "place").select("conv_id", "turn", "place")


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 20")
def o5_top_20(t):
    return W.top(t.events, ["user_id"], [F.desc("value"), c("event_id")], 20).select("user_id", "event_id", "rank")


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], '|') AS head FROM documents")
def o6_slice(t):
    return t.documents.select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 1, 2), "|").alias("head"))


@query("SELECT k FROM (SELECT s_suppkey AS k, 0 AS q FROM supplier UNION ALL SELECT c_custkey, 1 FROM customer) ORDER BY q, k LIMIT 150")
def o7_limit_over_union(t):
    both = t.supplier.select(c("s_suppkey").alias("k"), F.lit(0).alias("q")).unionAll(t.customer.select("c_custkey", F.lit(1)))
    return both.orderBy("q", "k").limit(150).select("k")


@query()
def o9_sample(t):
    return W.sample_first(t.orders, 100, c("o_orderkey")).select("o_orderkey")


@query()
def o10_sample_each(t):
    return W.top(t.orders, ["o_orderpriority"], [F.xxhash64("o_orderkey"), c("o_orderkey")], 500).select("o_orderpriority", "o_orderkey")


@query()
def o11_split(t):
    return W.split(t.orders, 0.1, c("o_orderkey")).select("o_orderkey", "split")


@query("SELECT p_brand, arg_min(p_name, length(p_name) * 10000000 + p_partkey) AS p_name FROM part GROUP BY 1")
def o13_shortest(t):
    return t.part.groupBy("p_brand").agg(F.min_by("p_name", F.struct(F.length("p_name"), c("p_partkey"))).alias("p_name"))


# sets -----------------------------------------------------------------------------------------


@query("SELECT 'c' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier")
def u1_union_all(t):
    return t.customer.select(F.lit("c").alias("kind"), c("c_nationkey").alias("k")).unionByName(t.supplier.select(F.lit("s").alias("kind"), c("s_nationkey").alias("k")))


@query("""SELECT conv_id, array_to_string([x FOR x, i IN l IF list_position(l, x) = i], ',') AS roles FROM (SELECT conv_id, list(role ORDER BY turn) AS l FROM conversations GROUP BY 1)""")
def u2_union_in_order(t):
    lists = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("l"))
    return lists.select("conv_id", F.array_join(F.array_distinct("l"), ",").alias("roles"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9800 INTERSECT SELECT s_nationkey FROM supplier")
def u3_intersect(t):
    return t.customer.where("c_acctbal > 9800").select(c("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def u4_except(t):
    return t.customer.select(c("c_nationkey").alias("k")).subtract(t.supplier.where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT user_id, list_has_all(list(DISTINCT event_type), ['click', 'view', 'error']) AS ok FROM events GROUP BY 1")
def u5_subset(t):
    have = F.collect_set("event_type")
    return t.events.groupBy("user_id").agg((F.size(F.array_except(F.array(*map(F.lit, ("click", "view", "error"))), have)) == 0).alias("ok"))
