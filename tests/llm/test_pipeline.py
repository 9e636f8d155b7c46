"""The pipeline's stages on a small corpus, each against what it is to do with its own input."""

import numpy as np

import corpus_pipeline
from brindle.llm import simhash
from brindle.llm.common import materialize


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_dedup", "pii", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, sf_dir), f"test-{name}")
        if name != "packing":
            assert after.columns == docs.columns and after.schema == docs.schema
        if name in ("line_dedup", "pii"):
            assert after.count() == before.count()
        if name == "simhash_dedup":
            # brute force: the smallest id of each group of alike texts joined by near fingerprints
            rows = before.select("doc_id", "text").orderBy("doc_id").collect()
            hashes = [simhash.shingle_hashes(r.text or "", corpus_pipeline.FEATURE) for r in rows]
            fps = np.array([[simhash.fingerprint(h), simhash.fingerprint(simhash.mixed(h))] for h in hashes], np.uint64)
            sets = [set(simhash.shingle_hashes(r.text or "", corpus_pipeline.SHINGLE).tolist()) for r in rows]

            def alike(i, j):
                both = len(sets[i] & sets[j])
                return both >= corpus_pipeline.SIMILARITY * (len(sets[i]) + len(sets[j]) - both)

            def groups(todo, near):
                left = set(todo)
                while left:
                    group, reach = set(), [min(left)]
                    while reach:
                        i = reach.pop()
                        if i in group:
                            continue
                        group.add(i)
                        reach += near(i, left)
                    left -= group
                    yield group

            kept = set()
            for close in groups(range(len(rows)), lambda i, _: np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= corpus_pipeline.RADIUS).any(1)).tolist()):
                for group in groups(close, lambda i, left: [j for j in left if alike(i, j)]):
                    kept.add(min(rows[i].doc_id for i in group))
            assert {r.doc_id for r in after.select("doc_id").collect()} == kept
        before = after
    assert {r[0] for r in before.select("doc_id").distinct().collect()} == kept


def test_run_and_extra_columns(spark, sf_dir, tmp_path):
    import shutil

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    extra = docs.selectExpr("*", "doc_id as fp", "text as words", "1 as score", "'x' as `a.b`").unionAll(docs.limit(1).selectExpr("cast(null as long)", "null", "null", "null", "null", "null", "null", "1", "null"))
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{sf_dir}/labels.parquet", tmp_path)
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, read, str(tmp_path)).columns == read.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = read.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
