import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from readloom.llm import mixing, queries


def plain_targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    return target


def plain_mix(rows, budget=None):
    """One list of all packets of all copies, sorted and cut."""
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows]
    size = defaultdict(int)
    for _, s, n in docs:
        size[s] += n
    target = plain_targets(size)
    packets, at, queue = [], defaultdict(int), []
    for k, (i, s, n) in enumerate(sorted(docs, key=lambda d: (hashlib.md5(("" if d[0] is None else str(d[0])).encode()).hexdigest(), d[0] or 0, d[2]))):
        queue.append((i, s, n))
        for copy in range(3):
            a = at[s] + copy * size[s]
            cut = min(max(int(target[s]), a), a + n)
            packets += [(z / target[s], (i is not None, i or 0), (s is not None, s or ""), copy, b, z - b, k) for b, z in ((a, cut), (cut, a + n)) if z > b]
        at[s] += n
    left = total = min(sum(size.values()), budget if budget is not None else 1 << 60)
    taken, first = defaultdict(int), {}
    for *_, n, k in sorted(packets):
        if left:
            first.setdefault(k, total - left)
        taken[k] += min(n, left)
        left -= min(n, left)
    return sorted((str(i), n, size[s], round(target[s], 3), taken[k], first.get(k, -1)) for k, (i, s, n) in enumerate(queue)), size, target


def got_of(df):
    return sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 3), r.taken, -1 if r.first_offset is None else r.first_offset) for r in df.collect())


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, size, target = plain_mix(rows)
    assert got_of(queries.op8_mixing(spark, sf_dir)) == want


def test_skewed_sources_and_caps(spark):
    rows = [(i, "big" if i % 3 else ["a", "b", None, "é"][i % 4], "w " * (i % 50)) for i in range(900)] + [(900, "tiny", "one two"), (901, "none", None), (902, "none", ""), (903, "none", "\x85 x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit(1)).repartition(7)
    want, size, target = plain_mix(rows)
    total = sum(size.values())
    assert got_of(mixing.mix(df)) == want and sum(r[4] for r in want) == total
    of = {str(i): s for i, s, _ in rows}
    taken = defaultdict(int)
    for i, n, *_, got, _ in want:
        taken[of[i]] += got
        assert got <= 3 * n
    assert all(abs(taken[s] - target[s]) <= len(size) + 1 for s in size) and any(target[s] == 3 * size[s] for s in size)
    for budget in (total // 2, 17, 0, total * 2):  # the mix ends in the middle of a copy
        want = plain_mix(rows, budget)[0]
        assert got_of(mixing.mix(df, budget=budget)) == want and sum(r[4] for r in want) == min(budget, total)


def test_plan_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, f"s{i % 4}", f"text {i} " * (i % 9)) for i in range(300)] + [(7, "s3", "text 7 " * 7)] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    one = [tuple(r) for r in mixing.mixed_documents(df).collect()]
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert [tuple(r) for r in mixing.mixed_documents(df).collect()] == one and len(one) > 250


def test_repeated_and_empty_rows(spark):
    rows = [(None, None, None)] * 3 + [(4, "s", "a b c")] * 3 + [(5, "t", "d e")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("_hash", F.lit(1))
    assert got_of(mixing.mix(df)) == plain_mix(rows)[0]
    whole = mixing.mixed_documents(df)
    assert whole.columns == df.columns and {r.text for r in whole.collect()} <= {"a b c", "d e"}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
