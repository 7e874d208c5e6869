import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import packing, queries, training_order
from readloom.llm.common import new_dir

PATH = packing.vocabulary_path()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_file(spark, sf_dir, tokenizer):
    enc = packing.encoder(PATH)
    assert enc.fast is not None
    odd = ["", " ", "a  b", " a\n b\n\n c ", "it's we'll I'D", "x y z\u0085w", "日本語 テスト", "a\tb\r\nc", "<|endoftext|> x", "١٢٣ 42 ½", "é—“q”…", "\x1c\x00 ok", "naïve façade!!! 3.14"]
    texts = odd + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150).collect()]
    for t in texts:
        assert np.frombuffer(enc.encode(t), enc.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_long_runs_of_white_space(spark, tokenizer):
    enc = packing.encoder(PATH)
    for t in (" " * 5_000_000 + "z", "a" + "\n" * 2_000_000 + "b", "\r\n \t" * 300_000 + "q", "x" + " " * (packing.LONG_BLANK - 1) + "y"):
        assert np.frombuffer(enc.encode(t), enc.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    rows = [(1, "a b"), (2, "a" + " " * 2_000_000 + "b")]
    check_pieces(packing.pieces(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, tokenizer)


def test_added_tokens_are_those_of_a_plain_encode(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "日<|endoftext|><|endoftext|> x", "a <|endoftext b"]
    stored = packing.tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in stored.collect()}
    assert got[0] == [64, 220, 50256, 275, 0]
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def check_pieces(rows, docs, tokenizer, length=1024):
    streams = {}
    for i, t in docs:
        streams.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    by_seq, total = {}, 0
    for r in rows:
        total += r["length"]
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
        assert any(len(s) == r.doc_tokens and zlib.crc32(np.array(s[r.start : r.start + r["length"]], "<u4").tobytes()) == r.ids_crc32 for s in streams[r.doc_id])
    assert total == sum(len(s) for v in streams.values() for s in v)
    for seq, parts in by_seq.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or seq == max(by_seq)


def test_query(spark, sf_dir, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_pieces(queries.op7_packing(spark, sf_dir).collect(), docs, tokenizer)


def test_edge_rows(spark, tokenizer):
    rows = [(None, None), (1, ""), (2, "a b"), (2, "a b"), (3, "long words " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).repartition(3)
    check_pieces(packing.pieces(df, length=64).collect(), rows, tokenizer, 64)
    assert packing.pieces(df.limit(0)).count() == 0


def test_order_follows_files_however_they_are_split(spark, tmp_path, tokenizer):
    rows = [(i, f"document {i} " * (i * 7 % 23)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id")
    df.write.option("parquet.block.size", "4096").parquet(f"file://{tmp_path}/docs")
    before, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for most in ("128m", "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            docs = spark.read.parquet(f"file://{tmp_path}/docs")
            seen.append((docs.rdd.getNumPartitions(), sorted(tuple(r) for r in packing.pieces(docs, length=64).collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0][0] < seen[1][0] and seen[0][1] == seen[1][1]
    place = [r[0] for r in sorted(seen[0][1], key=lambda r: (r[5], r[6]))]
    assert [i for i, p in zip(place, [None, *place], strict=False) if i != p] == list(range(400))
    both = spark.read.parquet(f"file://{tmp_path}/docs").join(spark.read.parquet(f"file://{tmp_path}/docs").select("doc_id"), "doc_id")
    check_pieces(packing.pieces(both, length=64).collect(), rows, tokenizer, 64)


def test_whole_sequences(spark, tokenizer):
    rows = [(i, "some words " * (i % 7)) for i in range(40)]
    stored = packing.tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH)
    want = b"".join(r.ids for r in sorted(stored.collect(), key=lambda r: (r.file, r.block, r.part, r.start)))
    seqs, n = packing.sequences(stored, PATH, length=24)
    got = sorted(seqs.collect(), key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in got] == list(range(n)) and b"".join(bytes(r.ids)[: 2 * r.n] for r in got) == want
    last = len(want) // 2 - 24 * (n - 1)
    assert len(got[-1].ids) == 2 * (last if last & (last - 1) == 0 else 24)


def test_pieces_are_cut_from_assembled_sequences(spark, tokenizer, monkeypatch):
    rows = [(None, "a null id")] + [(i, f"document {i} " * (i % 9)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    stored = {}
    keep = packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda df, name, **options: stored.setdefault(name, keep(df, name, **options)))
    got = packing.pieces(df, length=20).collect()
    check_pieces(got, rows, tokenizer, 20)
    packed = {r.sequence_id: np.frombuffer(r.ids, "<u2") for r in stored["sequences"].collect()}
    assert sorted(packed) == sorted({r.sequence_id for r in got}) == list(range(len(packed)))
    for r in got:
        assert zlib.crc32(packed[r.sequence_id][r.offset : r.offset + r["length"]].astype("<u4").tobytes()) == r.ids_crc32


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        p = training_order.Feistel(n, "k")
        slots = p.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (p.sequence(slots) == np.arange(n)).all()
    assert (training_order.Feistel(1000, "a").slot(range(1000)) != training_order.Feistel(1000, "b").slot(range(1000))).any()


def test_training_order(spark, tokenizer):
    rows = [(None, None), (1, "")] + [(i, f"document {i} " * (i % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit(1)).repartition(4)
    where = new_dir(spark, "shards")
    got = sorted(training_order.materialise_order(df, where, length=16, shard=8).collect(), key=lambda r: r.slot)
    n = len(got)
    perm = training_order.Feistel(n)
    assert [r.slot for r in got] == list(range(n)) and perm.slot([r.sequence_id for r in got]).tolist() == list(range(n))
    assert all(r.shard == r.slot // 8 and r.offset == r.slot % 8 * 32 for r in got)
    read = list(training_order.read_slots(where, 0, n, 16, "<u2", 8))
    assert all(zlib.crc32(x[: r.n_ids].astype("<u4").tobytes()) == r.ids_crc32 for x, r in zip(read, got, strict=True))
    resumed = list(training_order.read_slots(where, 13, n, 16, "<u2", 8))
    assert all((a == b).all() for a, b in zip(read[13:], resumed, strict=True))
    in_order = sorted(zip((r.sequence_id for r in got), read, (r.n_ids for r in got), strict=True), key=lambda x: x[0])
    stream = [i for _, x, k in in_order for i in x[:k].tolist()]
    docs = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows)
    cut, at = [], []
    for i in stream:
        at.append(i)
        if i == 0:
            cut.append(at)
            at = []
    assert sorted(cut) == docs and not at
    assert training_order.materialise_order(df.limit(0), new_dir(spark, "shards")).count() == 0


def test_training_order_query(spark, sf_dir):
    got = queries.op9_training_order(spark, sf_dir)
    r = got.selectExpr("count(*) n", "count(distinct slot) s", "count(distinct sequence_id) q", "max(slot) m", "sum(n_ids) ids").first()
    ids = queries.op7_packing(spark, sf_dir).selectExpr("sum(length) x").first().x
    assert r.n == r.s == r.q == r.m + 1 and r.ids == ids
