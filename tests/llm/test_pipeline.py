import itertools

from pyspark.sql import functions as F

import corpus_pipeline as cp
from readloom.llm import mixing, queries
from readloom.llm.common import materialise

from .test_simhash import near_copies, plain_similarity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    seen = {}
    for name, stage in cp.STAGES:
        new = materialise(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert new.columns == docs.columns
            assert not new.exceptAll(docs.withColumn("k", F.explode(F.array([F.lit(i) for i in range(3)]))).drop("k")).count()
        seen[name] = (docs, new)
        docs = new
    before, after = seen["quality_rules"]
    kept = {r.doc_id for r in queries.op4_quality_rules(spark, sf_dir).where("kept").collect()}
    assert {r.doc_id for r in after.where("doc_id IS NOT NULL").collect()} == kept and after.count() < before.count()
    before, after = seen["simhash_near_dedup"]
    assert after.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").count() == 0 and after.where("doc_id IS NULL").count() == 0
    before, after = seen["mixing"]
    w = mixing.n_words(F.col("text"))
    goal = {r.source: r.target for r in mixing.targets(before.select("source", w.alias("size"))).collect()}
    largest = before.agg(F.max(w)).first()[0]
    got = {r.source: r.n for r in after.groupBy("source").agg(F.sum(w).alias("n")).collect()}
    assert all(abs(got.get(s, 0) - t) <= largest / 2 + 1 for s, t in goal.items())
    before, after = seen["packing"]
    assert after.agg(F.sum("doc_tokens")).first()[0] >= after.agg(F.sum("length")).first()[0] > 0


def test_run_and_its_order(spark, sf_dir):
    """Packing follows the order of the mix, so two runs give the same pieces."""
    one, two = (sorted(tuple(r) for r in cp.run(spark, sf_dir).collect()) for _ in "ab")
    assert one == two and len(one) > 0


def test_near_copies_go(spark, sf_dir):
    rows = near_copies(groups=15)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    left = {r.doc_id for r in cp.near_dedup(spark, df, sf_dir).collect()}
    gone = [(i, t) for i, t in rows if i not in left]
    assert all(max(plain_similarity(t, u) for j, u in rows if j != i and j // 5 == i // 5) > 0.65 for i, t in gone)
    # of the pairs that are similar enough, at least nine of ten don't both stay, as the operator states
    both = [{i, j} <= left for (i, a), (j, b) in itertools.combinations(rows, 2) if i // 5 == j // 5 and plain_similarity(a, b) >= 0.8]
    assert len(both) > 30 and sum(both) <= 0.1 * len(both)


def test_empty_and_odd_tables(spark, sf_dir, tmp_path):
    """No rows at all; and rows of nulls, empty and repeated texts beside a column of a clashing name."""
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0
    long = " ".join(f"word{i * i % 997}" for i in range(20_000))
    rows = [(None, None, None), (1, None, "a"), (2, "", None), (2, "", None), (3, "few words", "a"), (None, long, "b"), (4, long, "b"), (4, long, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "fp": F.lit(1), "_copy": F.lit(2)})
    for name, stage in cp.STAGES:
        new = materialise(stage(spark, docs, sf_dir), name)
        assert name == "packing" or new.columns == docs.columns
        if name == "simhash_near_dedup":
            assert sorted(str(r.doc_id) for r in new.collect()) == ["1", "3", "4"]
        docs = new if name not in ("quality_rules", "quality_classifier") else docs
