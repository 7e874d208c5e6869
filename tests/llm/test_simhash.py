import itertools
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from readloom import storage
from readloom.llm import queries, simhash


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(keys):
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(keys[i + 1 :] ^ keys[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def clustered(seed, centres=20, each=40, spread=5):
    rng = np.random.default_rng(seed)
    keys = set()
    for c in rng.integers(0, 2**64, centres, dtype=np.uint64):
        for _ in range(each):
            k = int(c)
            for b in rng.choice(64, rng.integers(0, spread), replace=False):
                k ^= 1 << int(b)
            keys.add(k)
    return np.array(sorted(keys), dtype=np.uint64)


def test_fingerprint(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    for t in (None, "", " \n", "One", "one TWO", "a b c", "É a é B c D e f g h i j k l m n o p q r s t", "x " * 50):
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


def test_trie_join_is_exact(monkeypatch):
    for seed in range(4):
        keys = clustered(seed)
        want = plain_components(keys)
        for front in (simhash.FRONT, 50):
            monkeypatch.setattr(simhash, "FRONT", front)
            a, b = simhash.trie_links(keys, [(0, len(keys), 0, len(keys))])
            assert (np.bitwise_count(keys[a] ^ keys[b]) <= 3).all()
            parent = np.arange(len(keys))
            simhash._forest(len(keys), a, b, parent)
            assert (simhash._find(parent, np.arange(len(keys))) == want).all() and len(a) == len(keys) - len(set(want))


@pytest.mark.parametrize(("crowd", "chunked"), [(8, 10**6), (8, 64), (8, 16), (10**6, 10**6)])
def test_crowded_subtries_lose_no_link(spark, monkeypatch, crowd, chunked):
    """By chunks, by splitting again and again, and by both."""
    rng = np.random.default_rng(9)
    alike = [int(x) for x in rng.integers(0, 1 << 40, 300)]  # one prefix of 24 bits
    near = [x ^ sum({1 << int(b) for b in rng.integers(0, 40, 3)}) for x in alike[:60]]
    keys = np.unique(np.concatenate([np.array(alike + near, dtype=np.uint64) | np.uint64(0xABCDEF << 40), clustered(9, centres=6, each=12)]))
    want = plain_components(keys)
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "CHUNKED", chunked)
    got = {r.node: r.component for r in simhash.components(simhash.links(df)).collect()}
    label = [got.get(int(k), int(k)) for k in keys.view(np.int64)]
    assert len(set(zip(want, label, strict=True))) == len(set(want)) == len(set(label))


def test_bands_cut_any_word(spark):
    rng = np.random.default_rng(4)
    words = [int(x) for x in rng.integers(-(2**63), 2**63, 50)]
    for bits in (64, 48, 36, 27, 21, 9):
        rest = [w & ((1 << bits) - 1) for w in words]
        df = spark.createDataFrame([(w, r - (1 << 64) if r >> 63 else r) for w, r in zip(words, rest, strict=True)], "fp long, rest long").withColumn("unit", F.lit(1).cast("long"))
        n = bits // 4
        want = sorted((w, (r >> (n * j + n)) << (n * j) | r & ((1 << n * j) - 1)) for w, r in zip(words, rest, strict=True) for j in range(4))
        assert sorted((r.fp, r.rest) for r in simhash._bands(df, bits).collect()) == want


def test_a_third_of_all_rows_in_one_group(spark):
    """Copies of one text beside chains of near copies, with adaptive execution on and off."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, "the very same text again") for i in range(400)] + [(1000 + i, " ".join(base[:-1] + [f"end{i % 50}"])) for i in range(400)] + [(2000 + i, f"text {i} " * 20) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    out = []
    try:
        for on, most in (("true", "-1"), ("false", "10m")):
            spark.conf.set("spark.sql.adaptive.enabled", on)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            out.append({r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()})
            kept = {r.doc_id for r in simhash.one_per_group(df).collect()}
            assert kept == set(out[-1].values())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert out[0] == out[1] and {out[0][i] for i in range(400)} == {0}
    keys = np.array([plain_fingerprint(t) for _, t in sorted(rows)], dtype=np.uint64)
    ids = sorted(i for i, _ in rows)
    assert out[0] == {i: ids[r] for i, r in zip(ids, plain_components(keys), strict=True)}


def test_query_and_edge_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    ids = sorted(fp)
    root = plain_components(np.array([fp[i] for i in ids], dtype=np.uint64))
    want = {i: (f"{fp[i]:016x}", ids[r]) for i, r in zip(ids, root, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash_near_dedup(spark, sf_dir).collect()} == want
    odd = spark.createDataFrame([(None, None), (7, ""), (5, None), (5, None), (None, "x y z"), (9, "q")], "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("_hash", F.lit(2))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(odd).collect())
    assert got == sorted([("None", "5"), ("7", "5"), ("5", "5"), ("5", "5"), ("None", "None"), ("9", "9")])
    left = simhash.one_per_group(odd)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == ["5", "9", "None"]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def near_copies(seed=3, groups=40):
    """Texts with copies of which few or many words are replaced; (id, text)."""
    rng = np.random.default_rng(seed)
    common, out = [f"c{i}" for i in range(60)], []
    for g in range(groups):
        n = int(rng.integers(80, 500))
        base = [common[int(rng.zipf(1.4)) % 60] if rng.random() < 0.5 else f"w{g}x{int(rng.integers(0, 4000))}" for _ in range(n)]
        out.append(base)
        for _ in range(4):
            share = rng.choice([0.004, 0.01, 0.02, 0.06, 0.2])
            out.append([f"r{int(rng.integers(0, 10**6))}" if rng.random() < share else w for w in base])
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def plain_similarity(a, b):
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1])


def test_similar_texts_against_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame([*rows, (500, rows[7][1]), (None, rows[9][1])], "doc_id long, text string").repartition(5)
    marks, group = simhash.similar(df)
    root = {r.doc_id: r.root for r in marks.join(group, "fp").collect()}
    assert root[500] == root[7] and root[None] == root[9]
    caught = total = 0
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        s = plain_similarity(a, b) if i // 5 == j // 5 else 0
        caught += (s >= 0.8) and root[i] == root[j]
        total += s >= 0.8
        if i // 5 != j // 5:
            assert root[i] != root[j]
    assert total > 100 and caught >= 0.9 * total
    for g in range(40):  # a link needs a similarity near 0.8: without one, a text stays alone
        mine = rows[5 * g : 5 * g + 5]
        for i, a in mine:
            if max(plain_similarity(a, b) for j, b in mine if j != i) < 0.65:
                assert sum(root[j] == root[i] for j, _ in rows) == 1
    left = simhash.one_per_group(df, simhash.similar)
    assert {r.doc_id for r in left.collect()} == {min(i for i, x in root.items() if i is not None and x == k) for k in set(root.values())}


def test_similar_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STRIP", 7)
    odd = spark.createDataFrame([(None, None), (7, ""), (5, None), (5, None), (None, "x y z"), (9, "q"), (10, "Q"), (11, "z y x"), (12, "a b " * 60_000)], "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("_hash", F.lit(2))
    left = simhash.one_per_group(odd, simhash.similar)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == ["11", "12", "5", "9", "None"]
    assert simhash.one_per_group(odd.limit(0), simhash.similar).count() == 0


def test_checked_links_span_what_brute_force_links(spark, monkeypatch):
    """Keys that repeat, a second word beside them, crowds of any size."""
    rng = np.random.default_rng(21)
    keys = rng.choice(clustered(2, centres=5, each=30), 260)
    beside = (rng.integers(0, 2**63, 6, dtype=np.uint64)[rng.integers(0, 6, 260)]) ^ (np.uint64(1) << rng.integers(0, 63, 260, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 260, dtype=np.uint64))
    near = lambda i, j: np.bitwise_count(keys[i] ^ keys[j]) <= 3 and np.bitwise_count(beside[i] ^ beside[j]) <= 14
    parent = list(range(260))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i, j in itertools.combinations(range(260), 2):
        if near(i, j):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(f"n{i:03d}", int(np.int64(b.view(np.int64))), int(k.view(np.int64))) for i, (k, b) in enumerate(zip(keys, beside, strict=True))], "node string, beside long, fp long")
    for crowd, chunked, front in ((1024, 65536, simhash.FRONT), (8, 10**6, 50), (16, 32, 50)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "CHUNKED", chunked)
        monkeypatch.setattr(simhash, "FRONT", front)
        got = {r.node: r.component for r in simhash.components(simhash.links(df)).collect()}
        assert [int(got.get(f"n{i:03d}", f"n{i:03d}")[1:]) for i in range(260)] == [find(i) for i in range(260)]


def test_rounds_leave_one_table(spark, tmp_path, monkeypatch):
    """A long chain takes several rounds of contraction, whose tables go when the next ones are there."""
    monkeypatch.setattr(storage, "shared_root", lambda spark: f"file://{tmp_path}")
    got = simhash.components(spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))).collect()
    assert sorted(tuple(r) for r in got) == [(i, 0) for i in range(1, 41)]
    assert len(list((tmp_path / "readloom").iterdir())) == 1


def test_equal_keys_take_little_memory():
    """Thousands of equal keys with different second words: as many links at once as a block has, not all pairs of them."""
    rng = np.random.default_rng(4)
    group = rng.integers(0, 5, 3000)
    beside = rng.integers(0, 2**63, 5, dtype=np.uint64)[group] ^ (np.uint64(1) << rng.integers(0, 63, 3000, dtype=np.uint64))
    tracemalloc.start()
    a, b = simhash.trie_links(np.full(3000, 77, dtype=np.uint64), [(0, 3000, 0, 3000)], budget=4, beside=beside)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == 2995 and (group[a] == group[b]).all() and peak < 100e6


def test_known_clusters_and_families_lose_no_link(spark, monkeypatch):
    """The links and those that are known of a cluster join what brute force joins, by the keys of either family."""
    rng = np.random.default_rng(22)
    one, two = (rng.choice(clustered(s, centres=3, each=40, spread=4), 240) for s in (5, 6))
    beside = np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 63, 240, dtype=np.uint64))
    beside[:40] = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = lambda k, i, j: np.bitwise_count(k[i] ^ k[j]) <= 4 and np.bitwise_count(beside[i] ^ beside[j]) <= 14
    root = plain_groups(240, [(i, j) for i, j in itertools.combinations(range(240), 2) if near(one, i, j) or near(two, i, j)])
    first = plain_groups(240, [(i, j) for i, j in itertools.combinations(range(240), 2) if near(one, i, j)])
    largest = max(set(first), key=first.count)
    mine = [i for i in range(240) if first[i] == largest]
    assert 40 < len(mine) < 200 and len(set(root)) > 10
    long = lambda x: int(np.uint64(x).view(np.int64))
    rows = [(f"n{i:03d}", long(beside[i]), k, long(v[i]), long(one[i]), "c" if i in mine else None) for i in range(240) for k, v in ((1, one), (2, two))]
    df = spark.createDataFrame(rows, "node string, beside long, family int, fp long, other long, cluster string")
    known = spark.createDataFrame([(f"n{mine[0]:03d}", f"n{i:03d}") for i in mine[1:]], "u string, v string")
    for crowd, chunked in ((1024, 65536), (8, 10**6), (8, 32)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "WIDE", 2 * crowd)
        monkeypatch.setattr(simhash, "CHUNKED", chunked)
        got = {r.node: r.component for r in simhash.components(simhash.links(df, 4).unionByName(known)).collect()}
        assert [int(got.get(f"n{i:03d}", f"n{i:03d}")[1:]) for i in range(240)] == root


def plain_groups(n, pairs):
    parent = list(range(n))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    return [find(i) for i in range(n)]


def test_a_crowd_of_near_copies(spark, monkeypatch):
    """Near copies of one text: rows of the join don't grow with their square, and those that are similar come to one group."""
    monkeypatch.setattr(simhash, "CROWD", 16)
    monkeypatch.setattr(simhash, "WIDE", 64)
    monkeypatch.setattr(simhash, "LEADERS", 8)
    monkeypatch.setattr(simhash, "LED", 50)
    rng = np.random.default_rng(8)
    base = [f"w{int(x)}" for x in rng.integers(0, 300, 200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        text = list(base)
        for p in rng.integers(0, 200, int(rng.integers(1, 3))):
            text[p] = f"r{i}x{p}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"o{i}x{int(x)}" for x in rng.integers(0, 300, 60))) for i in range(20)]
    dealt, join = [], simhash._join_units
    monkeypatch.setattr(simhash, "_join_units", lambda units, budget: dealt.append(units.count()) or join(units, budget))
    marks, group = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    root = {r.doc_id: r.root for r in marks.join(group, "fp").collect()}
    assert len({root[i] for i in range(400)}) == 1 and len(set(root.values())) == 21
    assert sum(dealt) < 10 * len(rows) * 5  # of pairs of chunks alone it would be some 25 rows for each of ten bands
