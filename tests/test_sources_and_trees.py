import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import grading, joining, patches, upsert
from brindle.operators import source_tree as S
from brindle.sources import jsonl, search
from brindle.streaming import flows

KV = T.StructType([T.StructField("full_name", T.StringType()), T.StructField("stars", T.LongType()), T.StructField("place", T.LongType())])


def test_upsert_keeps_place(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 1), (None, 5, 2)], KV)
    new = spark.createDataFrame([("c", 3, 0), ("a", 2, 1), ("a", 9, 2), (None, 6, 3)], KV)
    got = [(r.full_name, r.stars) for r in upsert.upsert(old, new, "full_name").orderBy("place").collect()]
    assert got == [("a", 9), ("b", 1), (None, 5), ("c", 3), (None, 6)]
    assert tuple(upsert.upsert_counts(old, new, "full_name").first()) == (2, 2, 5)


def test_jsonl(spark, tmp_path):
    path = f"{tmp_path}/x.jsonl"
    assert jsonl.read_jsonl(spark, path, KV).count() == 0
    (tmp_path / "x.jsonl").write_text('{"full_name":"é","stars":1}\n\n{"full_name":"b"}\n')
    assert jsonl.read_jsonl(spark, path, KV).count() == 2
    (tmp_path / "y.jsonl").write_text('{"full_name":"a"}\n[1]\n{bad\n')
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, f"{tmp_path}/y.jsonl", KV).collect()
    assert sorted(r.line for r in jsonl.bad_lines(spark, f"{tmp_path}/y.jsonl").collect()) == ["[1]", "{bad"]
    df = spark.createDataFrame([("b", None, ("y", 1))], "z string, a string, m struct<q:string,p:int>")
    jsonl.write_jsonl(df, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").first()[0] == '{"a":null,"m":{"p":1,"q":"y"},"z":"b"}'


def test_predictions(spark, tmp_path):
    rows = [{"instance_id": "a", "model_name_or_path": "m", "model_patch": "p"}]
    (tmp_path / "l.json").write_text(json.dumps(rows))
    (tmp_path / "d.json").write_text(json.dumps({"a": rows[0]}))
    (tmp_path / "x.jsonl").write_text(json.dumps(rows[0]) + "\n")
    for name in ("l.json", "d.json", "x.jsonl"):
        assert [r.asDict() for r in jsonl.read_predictions(spark, f"{tmp_path}/{name}").collect()] == rows
    data = spark.createDataFrame([("a", "diff")], "instance_id string, patch string")
    assert jsonl.read_predictions(spark, "gold", data).first().model_patch == "diff"


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/table"
    for rows in ([("a", 1, 0)], [("a", 2, 0), ("b", 3, 1)]):
        got = jsonl.upsert_table(spark, path, spark.createDataFrame(rows, KV), "full_name")
    assert sorted((r.full_name, r.stars) for r in got.collect()) == [("a", 2), ("b", 3)] and jsonl.current_version(spark, path) == 1


def test_pages():
    items = [{"full_name": str(i)} for i in range(250)]
    fetch = lambda q, page, n: {"total": 250, "items": items[(page - 1) * n : page * n]}
    assert [len(p["items"]) for p in search.pages(fetch, "q")] == [100, 100, 50]
    assert [len(p["items"]) for p in search.pages(fetch, "q", limit=150)] == [100, 50]
    tries = []

    def flaky(q, page, n):
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return {"total": 0, "items": []}

    waits = []
    assert list(search.pages(flaky, "q", sleep=waits.append))[0]["fetched"] == 0 and waits == [1, 2]


def test_search_source(spark):
    spark.dataSource.register(search.SearchSource)
    recorded = json.dumps({"a": [{"full_name": f"r{i}", "stars": i, "language": "ts"} for i in range(30)], "b": [{"full_name": "x", "stars": 1}]})
    df = spark.read.format("paged_search").option("queries", json.dumps(["a", "b"])).option("recorded", recorded).option("limit", 12).load()
    assert df.groupBy("source_query").count().orderBy("source_query").collect() == [("a", 12), ("b", 1)]


SOURCE = """import { Base as B, helper } from './base'
import fs from "fs"

// class Fake {
@Entry
@Component
export struct Page {
  @State title: string = "{ not a brace"
  async load(id: number) {
    helper(id)
    B.make(id).then((x) => {
      show(x)
    })
    if (id) { other?.call(1) }
  }
  build() {
    Column() {
      Text("x")
    }
  }
}
/* function hidden() { */
function free(a) { return helper(a) }
"""


def test_masking_keeps_shape():
    masked = S.mask(SOURCE + "'open")
    assert len(masked) == len(SOURCE) + 5 and masked.count("\n") == SOURCE.count("\n")
    assert "Fake" not in masked and "hidden" not in masked and "brace" not in masked and "open" not in masked


def test_tree():
    got = [(n["type"], n["qualified"], n["start"], n["end"], n["depth"]) for n in S.nodes(SOURCE)]
    assert got == [
        ("struct", "Page", 7, 21, 1), ("property", "Page.title", 8, 8, 2), ("method", "Page.load", 9, 15, 2), ("callback", "Page.load.anonymous@11", 11, 13, 3),
        ("method", "Page.build", 16, 20, 2), ("ui_component", "Page.build.Column", 17, 19, 3), ("function", "free", 23, 23, 1),
    ]
    assert S.nodes(SOURCE)[0]["decorators"] == ["@Entry", "@Component"] and S.nodes(SOURCE)[2]["modifiers"] == ["async"]
    assert S.nodes(SOURCE)[2]["owner"] == "Page"


def test_graph(spark):
    files = spark.createDataFrame([
        ("src/page.ets", SOURCE), ("src/base.ts", "export function helper(a) {\n  one(a); two(a); three.four(a)\n  return a\n}\nexport class Base {\n  make(x) { return x }\n}\n"),
        ("src/more/index.ts", "import * as base from '../base'\nfunction go() {\n  base.helper(1)\n}\n"),
    ], "path string, source string")
    n, i, k = (S.parse(files, part) for part in ("nodes", "imports", "calls"))
    edges = S.resolve(S.bindings(i), files)
    found = {(r.path, r.kind, r.imported, r.local, r.target) for r in edges.collect()}
    assert ("src/page.ets", "named", "Base", "B", "src/base.ts") in found and ("src/more/index.ts", "namespace", "*", "base", "src/base.ts") in found
    assert ("src/page.ets", "default", "default", "fs", None) in found
    used = S.consumers(edges, n, k)
    assert {(r.name, r.path, r.scope) for r in used.collect()} >= {("helper", "src/page.ets", "Page.load"), ("helper", "src/page.ets", "free"), ("helper", "src/more/index.ts", "go"), ("make", "src/page.ets", "Page.load.anonymous@11")}
    best = S.candidates(n, k, used).first()
    assert (best.qualified, best.out_degree, best.downstream) == ("helper", 3, 3)
    calls = {(r.callee, r.scope) for r in S.prefixed_calls(k, n, ["other.", "show"]).collect()}
    assert calls == {("other.call", "Page.load"), ("show", "Page.load.anonymous@11")}
    total = S.summary(n, i, k, files).first()
    assert total.files == 3 and total.imports == 3 and total.max_depth == 3 and total.node_types["method"] == 3


def test_files(spark, tmp_path):
    for p in ("a.ets", "lib/b.TS", "node_modules/c.ts", "d.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    assert sorted(r.path.split("/")[-1] for r in S.source_files(spark, str(tmp_path)).collect()) == ["a.ets", "b.TS"]


PATCH = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -1,5 +1,6 @@ def f():
 one
-two
--- three
+2
+three
+more
 four
 five
diff --git a/tests/t.py b/tests/t.py
--- /dev/null
+++ b/tests/t.py
@@ -0,0 +1,1 @@
+new
"""


def test_patches(spark):
    df = spark.createDataFrame([(1, PATCH)], "k int, patch string")
    rows = patches.hunks(df, "k", "patch").orderBy("file").collect()
    assert [(r.target, r.kind, r.added, r.removed, r.context) for r in rows] == [("b/src/a.py", "modified", 3, 2, 3), ("b/tests/t.py", "added", 1, 0, 0)]
    s = df.select(patches.split_tests(df.patch).alias("s"), patches.touched(df.patch).alias("t"), patches.created(df.patch).alias("c"), patches.minimized(df.patch).alias("m")).first()
    assert s.s.fix + s.s.test == PATCH and s.s.test.startswith("diff --git a/tests/t.py") and s.t == ["src/a.py"] and s.c == ["tests/t.py"]
    assert "@@ -2,2 +2,3 @@\n-two\n" in s.m


def test_made_patches_apply():
    before, after = "a\nb\nc\nd\n", "a\nB\nc\nd\ne"
    for n in (0, 3):
        made = patches.make("x.ts", before, after, n)
        assert made.startswith("--- a/x.ts\n+++ b/x.ts\n") and "\\ No newline at end of file" in made
    wrong = patches.make("x.ts", before, after).replace("-1,4 +1,5", "-1,9 +3,9")
    assert "@@ -1,4 +1,5 @@" in patches.repair(wrong)


def test_grading(spark):
    expected = spark.createDataFrame([("i", "F2P", "a"), ("i", "F2P", "b"), ("i", "P2P", "c")], "id string, category string, test string")
    got = spark.createDataFrame([("i", "a", "PASSED"), ("i", "c", "FAILED")], "id string, test string, status string")
    rows = {r.category: (r.success, r.failure) for r in grading.grade(expected, got, ["id", "test"]).collect()}
    assert rows == {"F2P": (["a"], ["b"]), "P2P": ([], ["c"])}


def test_containment_files_by_inner_words(spark):
    texts = spark.createDataFrame([(1, "xxalpha beta gammayy"), (2, "only short"), (3, None)], "k int, t string")
    needles = spark.createDataFrame([(10, "Alpha BETA gamma"), (11, "short"), (12, "beta beta beta")], "n int, s string")
    assert sorted(tuple(r) for r in joining.contains_any(texts, needles, "k", "t", "n", "s").collect()) == [(1, 10), (2, 11)]


def test_paired_stream(spark, tmp_path):
    rows = [("t", "a", 1, "start", "x"), ("t", "b", 2, "start", "y"), ("t", "a", 3, "end", None), ("t", "c", 4, "end", "z")]
    schema = "track string, action string, seq long, kind string, tool string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = flows.pair_actions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("paired").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.sql("select action, start, `end`, tool from paired").collect())
    assert got == [("a", 1, 3, "x"), ("c", None, 4, "z")]


def test_late_appends(spark):
    log = spark.createDataFrame([("t", 1), ("t", 5), ("u", 9)], "track string, seq long")
    tracks = spark.createDataFrame([("t", 4), ("u", None)], "track string, closed_seq long")
    assert [(r.track, r.seq) for r in flows.late_appends(log, tracks).collect()] == [("t", 5)]


def test_asof_and_equal_times(spark):
    a = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "z", 9)], "id int, by string, t int")
    b = spark.createDataFrame([("k", 1, "v1"), ("k", 5, "v5"), ("k", 3, "v3")], "by string, t int, v string")
    for strict, want in ((True, {1: "v3", 2: None, 3: None}), (False, {1: "v5", 2: "v1", 3: None})):
        assert {r.id: r.x for r in joining.asof(a, b, "t", "t", ["by"], {"v": "x"}, strict).select(F.col("id"), "x").collect()} == want
