from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import filtering as P

c = F.col


def test_reasons_repeat_and_keep_order(spark):
    df = spark.createDataFrame([(1, True, True, 3, "2023-01-01"), (2, False, False, 50, "2025-01-01"), (3, None, None, None, None)], "id int, archived boolean, fork boolean, stars int, updated string")
    df = df.withColumn("updated", c("updated").cast("timestamp_ntz"))
    rules = [P.Rule("archived", c("archived")), P.Rule("fork", c("fork")), *P.bounds(c("stars"), "stars_below_min", "stars_above_max", 10, 100), *P.date_bounds(c("updated"), "updated_out_of_range", "2024-01-01", "2026-01-01")]
    got = {r.id: r.reasons for r in P.with_reasons(df, rules).collect()}
    assert got == {1: ["archived", "fork", "stars_below_min", "updated_out_of_range"], 2: [], 3: ["stars_below_min", "updated_out_of_range", "updated_out_of_range"]}
    assert [r.id for r in P.keep(df, rules).collect()] == [2]
    assert {r.reason: r.n for r in P.reject_counts(df, rules).collect()}["updated_out_of_range"] == 3


def test_lists(spark):
    df = spark.createDataFrame([(1, " TypeScript ", ["A", "b "]), (2, "go", None), (3, None, ["a"])], "id int, language string, topics array<string>")
    rules = [*P.member(c("language"), ["typescript"], "language"), *P.requires_all(c("topics"), ["a", "B"], "topics")]
    assert {r.id: r.reasons for r in P.with_reasons(df, rules).collect()} == {1: [], 2: ["language", "topics"], 3: ["language", "topics"]}


def test_staged(spark):
    df = spark.createDataFrame([("old", 20, 1), ("new", 30, 9), ("low", 1, 9)], "name string, stars int, day int")
    kept, counts = P.staged(df, [("stars", c("stars") > 10), ("day", c("day") >= 5)])
    assert [r.name for r in kept.collect()] == ["new"] and [(r.n_in, r.n_out) for r in counts.orderBy("position").collect()] == [(3, 2), (2, 1)]


def test_confidence_levels(spark):
    rows = [(True, 2, False, "high"), (True, 1, True, "medium"), (False, 3, True, "medium"), (True, 0, True, "low"), (True, 1, False, "none"), (False, 2, True, "none")]
    df = spark.createDataFrame(rows, "main boolean, markers int, kw boolean, want string")
    for r in df.withColumn("got", P.confidence(c("main"), c("markers"), c("kw"))).collect():
        assert r.got == r.want


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda x: one.select(x.alias("x")).first().x
    assert get(X.resolved_issues(F.lit("Fixes #12, closes  #3 see #4 <!-- fix #9 --> FIXED #12"))) == ["12", "3"]
    assert get(X.first_diff(F.lit("a <patch>\nx</patch> ```diff\ny```"))) == "\nx"
    assert get(X.first_diff(F.lit("plain</s>rest"))) == "plain"
    assert get(X.quote_term(F.lit(" a b "))) == '"a b"' and get(X.quote_term(F.lit("ab"))) == "ab"
    assert get(X.instance_id(F.lit("own/name"), F.lit(7))) == "own__name-7"
    slices = get(X.month_slices(F.lit("2024-01-10").cast("date"), F.lit("2024-03-02").cast("date")))
    assert [(str(s.lo), str(s.hi)) for s in slices] == [("2024-01-10", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-02")]
    items = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate((4, 9, 3, 2))))
    assert [x.i for x in get(X.pack_fold(items, lambda x: x["n"], 10)).kept] == [0, 2, 3][:3]
    for t in ("2026-01-01T00:00:00Z", "2026-01-01", "2026-01-01T08:00:00+08:00"):
        assert str(get(X.parse_time(F.lit(t)))) == "2026-01-01 00:00:00"


def test_closure_follows_long_chains(spark):
    from brindle.operators import joining

    edges = spark.createDataFrame([(i, i + 1) for i in range(52)] + [(52, 50)], "a long, b long").coalesce(1)
    got = joining.closure(edges, "a", "b", spark.createDataFrame([(0,)], "a long").coalesce(1))
    assert {r.node: r.depth for r in got.collect()} == {i: i for i in range(53)}
