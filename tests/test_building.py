"""Defined results of dataset-building operators on odd inputs."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import curating, oracles, prompts, records, source_tree, tracks
from brindle.plans import catalog
from brindle.sources import config, jsonl


def test_settings():
    base = {"a": {"b": 1, "c": [1]}, "d": 2}
    assert config.merged(base, {"a": {"b": 5}, "d": {"e": 1}}) == {"a": {"b": 5, "c": [1]}, "d": {"e": 1}} and base["a"]["b"] == 1
    assert config.listed(None) == config.listed("") == [] and config.listed((1, 2)) == [1, 2] and config.listed("x") == ["x"]
    assert jsonl.suffixed("a/b.jsonl", "high") == "a/b-high.jsonl" and jsonl.suffixed("a.b/c", "x") == "a.b/c-x"


def test_merged_shards(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"s-{i}.jsonl").write_text('{"k": %d}\n' % i)
    assert jsonl.merge_shards(spark, f"{tmp_path}/s-*.jsonl", f"{tmp_path}/all", 3) == 3
    with pytest.raises(ValueError):
        jsonl.merge_shards(spark, f"{tmp_path}/s-*.jsonl", f"{tmp_path}/none", 4)
    assert not (tmp_path / "none").exists()


def test_odd_records(spark):
    df = spark.createDataFrame([("2024-02", "yml: 1\n"), ("2024-02-03T04", "- pip:\n  - yanked\n"), ("no", ""), (None, None)], "d string, y string")
    ends = df.select(records.date_boundary(F.col("d"), True).cast("string").alias("d")).collect()
    assert [r.d for r in ends] == ["2024-02-29", "2024-02-03", None, None]
    clean = df.select(curating.clean_environment(F.col("y"), [("yanked", None)]).alias("y")).collect()
    assert [r.y for r in clean] == ["yml: 1\n", "- pip:\n", "", None]
    repos = spark.createDataFrame([("x", None)], "full_name string, topics array<string>")
    r = records.repository_record(repos, fetched_at=F.lit("t")).first()
    assert (r.owner, r.repo, r.license, r.topics, r.language) == ("x", "", None, [], None)


def test_odd_tracks(spark):
    rows = [("a", '[{"response":{"type":"tool_call","arguments":null}}]', "{}"), ("b", "no json", None), ("c", None, '{"mask":{"path":"M"}}')]
    got = {r.track_id: r for r in tracks.evaluate(spark.createDataFrame(rows, "track_id string, responses string, task_metadata string")).collect()}
    assert got["a"].total == 1 and got["a"].known == 0 and got["a"].recall is None
    assert got["b"].total is None and got["b"].rounds in (0, 1) and got["c"].recall == 0.0 and got["c"].rounds == 0


def test_odd_declarations_and_contexts(spark):
    df = spark.createDataFrame([("interface A {}",), ("",), (None,)], "s string")
    assert [r.n for r in df.select(F.size(oracles.interface_fields(F.col("s"), F.lit("A"))).alias("n")).collect()] == [0, 0, None]
    files = spark.createDataFrame([("r", "c", "a", "t")], "repo string, commit string, path string, text string")
    instances = spark.createDataFrame([(1, "r", "c", None)], "instance_id int, repo string, commit string, patch string")
    for source, n in (("none", 0), ("oracle", 0), ("all", 1)):
        r = prompts.text_inputs(instances, source, files).first()
        assert r.n_files == n and (r.context == "") == (n == 0)
    with pytest.raises(ValueError):
        prompts.wanted_files(instances, "other", files)


def planned(spark, sf_dir, name):
    """The plan of a query before it runs, under Spark's own broadcast threshold."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    return catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_verified_instances_pass_no_parsed_rows_through_the_driver(spark, sf_dir):
    # the planner takes all rows that are parsed from a small table for a few bytes each
    assert "Broadcast" not in planned(spark, sf_dir, "g13_verified_instances")


def test_resolved_imports_keep_their_target(spark):
    clause = "import Base, { A as B, A } from './a'\n"
    files = spark.createDataFrame([("k/a.ts", "export interface A {}\n"), ("k/b.ts", clause * 2 + "import { A } from './none'\n"), ("k/c.ts", None)], "path string, source string")
    got = source_tree.bindings(source_tree.resolve(source_tree.parse(files, "imports"), files)).collect()
    rows = sorted((r.source, r.target, r.kind, r.imported, r.local) for r in got if r.target)
    assert rows == sorted(2 * [("./a", "k/a.ts", "default", "default", "Base"), ("./a", "k/a.ts", "named", "A", "B"), ("./a", "k/a.ts", "named", "A", "A")])
    assert [(r.path, r.source, r.local) for r in got if not r.target] == [("k/b.ts", "./none", "A")]


def test_implementers_pass_no_parsed_rows_through_the_driver(spark, sf_dir):
    assert "Broadcast" not in planned(spark, sf_dir, "j14_implementers")


def test_implementers_pass_no_parsed_rows_through_the_driver_as_they_run(spark, sf_dir):
    # sizes that are known only while it runs turn no join into a broadcast, either
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        found = catalog.queries()["j14_implementers"](spark, sf_dir)
        assert len(found.collect()) == 3 * spark.read.parquet(f"{sf_dir}/part.parquet").count()
        ran = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "isFinalPlan=true" in ran and "Broadcast" not in ran


def test_feature_candidates_pass_no_parsed_rows_through_the_driver(spark, sf_dir):
    assert "Broadcast" not in planned(spark, sf_dir, "g10_feature_candidates")
