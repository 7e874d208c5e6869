import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.llm import additive, boosted_rules, queries
from readloom.llm.textstats import FEATURES, statistics


def plain_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(), st.lists(st.sampled_from(["a", "b", "é|", "c#", "\n", "a b a", "\x0b", "\x85"]), max_size=60).map(" ".join)))
def test_statistics(text):
    assert statistics(None if text is None else text.encode())[0] == plain_counts(text)


def test_many_distinct_words():
    ids = np.arange(3_000_000) % 2_500_000
    from readloom.llm.textstats import repeated_word_mask

    assert repeated_word_mask(ids).sum() == 2 * 500_000


def sample(n=3000):
    rng = np.random.default_rng(3)
    x = rng.random((n, len(FEATURES)))
    return x, ((x[:, 2] + 0.5 * x[:, 0] * x[:, 6] + rng.normal(0, 0.05, n)) < 0.7).astype(float)


def test_trees_are_monotone_and_flat_walk_equals_plain_walk():
    x, y = sample()
    m = boosted_rules.fit(x, y, trees=20)
    assert ((m.margin(x) > 0) == y).mean() > 0.9
    for name in boosted_rules.MONOTONE:
        k = FEATURES.index(name)
        grid = np.repeat(x[:200], 20, axis=0)
        grid[:, k] = np.tile(np.linspace(-1, 2, 20), 200)
        assert (np.diff(m.margin(grid).reshape(200, 20), axis=1) <= 1e-9).all()

    def walk(row):
        total = m.base
        for f, t, v in zip(m.feature, m.threshold, m.value, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > t[at])
            total += v[at - len(f)]
        return total

    assert np.allclose([walk(r) for r in x[:50]], m.margin(x[:50]))


def test_additive_model_looks_up_tables():
    x, y = sample()
    m = additive.fit(x, y, rounds=40)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.93 and m.pairs
    row = x[:1]
    total = m.base + sum(t[np.searchsorted(c, v)] for c, t, v in zip(m.cuts, m.tables, row[0], strict=True))
    total += sum(t[np.searchsorted(m.coarse[a], row[0, a]), np.searchsorted(m.coarse[b], row[0, b])] for a, b, t in m.pairs)
    assert np.isclose(total, m.margin(row)[0])


@pytest.mark.parametrize("fit", [boosted_rules.fit, additive.fit])
def test_one_class_or_none(fit):
    x, y = sample(50)
    for m in (fit(x, np.ones(50)), fit(x[:0], y[:0])):
        assert len(set(np.round(m.margin(x), 9))) == 1


def test_queries_on_all_rows(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.op4_quality_rules(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        n, chars, symbols, dup, repeat = plain_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.kept and r.base_failed)
    kept = {r.doc_id: r.kept or r.base_failed for r in got}
    right = [kept[i] == bool(q) or (not q and not kept[i]) for i, q in labels.items() if i in kept and not next(r for r in got if r.doc_id == i).base_failed]
    assert np.mean(right) > 0.9
    got = queries.op10_quality_classifier(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]) > 0.9


def plain_sample(docs, labels):
    """Features and labels of the rows that aren't held out, by id."""
    ids = sorted(i for i, q in labels.items() if q is not None and i in docs and zlib.crc32(str(i).encode()) % 3 != 1)
    return np.array([statistics((docs[i] or "").encode())[1] for i in ids]), np.array([float(labels[i]) for i in ids])


def test_verdicts_and_scores_by_a_plain_scorer(spark, sf_dir):
    """Every row of both queries, scored a tree and a table at a time from models fitted on a plainly made sample."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    x, y = plain_sample(docs, labels)
    trees, gam = boosted_rules.fit(x, y), additive.fit(x, y)

    def tree_score(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-total))

    def table_score(row):
        total = gam.base + sum(t[sum(v > c for c in cuts)] for cuts, t, v in zip(gam.cuts, gam.tables, row, strict=True))
        total += sum(t[sum(row[a] > c for c in gam.coarse[a]), sum(row[b] > c for c in gam.coarse[b])] for a, b, t in gam.pairs)
        return 1 / (1 + np.exp(-total))

    rows = {i: statistics((t or "").encode())[1] for i, t in docs.items()}
    for r in queries.op4_quality_rules(spark, sf_dir).collect():
        s = tree_score(rows[r.doc_id])
        assert abs(r.tree_score - s) < 1e-9 and r.kept == (not r.base_failed and s >= 0.5)
    for r in queries.op10_quality_classifier(spark, sf_dir).collect():
        s = table_score(rows[r.doc_id])
        assert abs(r.score - s) < 1e-9 and r.predicted == int(s >= 0.5)


def test_repeated_labelled_rows_are_one(spark):
    """However often a labelled document comes, the sample has a row of it."""
    from readloom.llm.labelled import labelled_sample

    rows = [(i, f"text {i} of some words") for i in range(60)] * 2 + [(7, "another text of seven")] * 300 + [(None, "x")]
    labels = [(i, i % 2) for i in range(60)] + [(8, 1), (None, 1), (9, None), (99, 1)]
    x, y = labelled_sample(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(x) == len(y) == len(kept) and y.tolist() == [1.0 if i == 8 else i % 2 for i in kept]


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "w " * 200_000)], "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("_raw", F.lit("x"))
    x, y = sample(200)
    assert [r.base_failed for r in boosted_rules.quality_rules(df, boosted_rules.fit(x, y, trees=2)).collect()] == [True] * 4
    assert len({r.score for r in additive.quality_scores(df, additive.fit(x, y, rounds=2)).collect()[:3]}) == 1
    assert boosted_rules.passing(df, boosted_rules.fit(x, y, trees=2)).columns == df.columns
    none = df.limit(0)
    assert additive.quality_scores(none, additive.fitted(none, none.selectExpr("doc_id", "1 AS quality"))).count() == 0
    assert boosted_rules.quality_rules(none, boosted_rules.fitted(none, none.selectExpr("doc_id", "1 AS quality"))).count() == 0
