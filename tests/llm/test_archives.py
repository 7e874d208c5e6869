import base64
import gzip
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import media, queries, warc
from readloom.llm.common import new_dir, store, surt


def want_warc(pages, least=0):
    first = {}
    for p in pages:
        b = (p["html"] or "").encode()
        if len(b) >= least and p["page_id"] is not None:
            first[b] = min(first.get(b, p["page_id"]), p["page_id"])
    out = []
    for p in pages:
        b = (p["html"] or "").encode()
        f = first.get(b)
        revisit = f is not None and f != p["page_id"]
        out.append((p["page_id"], len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_surt():
    assert surt("https://M.Example.org:80/a?b") == "org,example,m)/a?b" and surt(None) == ")" and surt("mailto:x") == ")mailto:x"


def test_warc_query(spark, sf_dir):
    pages = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op2_warc_round_trip(spark, sf_dir).collect()), key=str) == want_warc(pages)


def test_warc_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    rows = [(5, "http://a.b/x", "same"), (3, "http://a.b/x", "same"), (3, "http://a.b/x", "same"), (None, None, None), (8, "http://z/\r\ny", ""), (9, "http://a.b/x", "é" * 70_000), (-4, "q", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2))
    pages = [dict(zip(("page_id", "url", "html"), r, strict=True)) for r in rows]
    assert sorted((tuple(r) for r in warc.archive_round_trip(spark, df).collect()), key=str) == want_warc(pages)
    assert sorted((tuple(r) for r in warc.archive_round_trip(spark, df, min_bytes=5).collect()), key=str) == want_warc(pages, 5)
    assert warc.archive_round_trip(spark, df.limit(0)).count() == 0
    assert warc.archive_round_trip(spark, df.where("page_id < 4").unionByName(df.where("page_id = 9"))).count() == 4


def test_hot_keys_and_payloads(spark, monkeypatch):
    """A third of the rows share url and payload, without an id; few payloads may be broadcast."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(None, None, "hot") if i % 3 == 0 else (i, f"http://h{i % 7}/{i}", f"page {i % 40}") for i in range(240)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    want = want_warc([dict(zip(("page_id", "url", "html"), r, strict=True)) for r in rows])
    for most in (warc.MAX_BROADCAST, 3, 0):
        monkeypatch.setattr(warc, "MAX_BROADCAST", most)
        assert sorted((tuple(r) for r in warc.archive_round_trip(spark, df).collect()), key=str) == want


def test_index_blocks_and_ranges(spark):
    df = spark.range(500).selectExpr("concat('k', lpad(cast(id div 3 as string), 4, '0')) AS key", "'f' AS archive", "id AS offset", "1L AS length")
    where = new_dir(spark, "index")
    shards = warc.build_index(df, where, block_lines=7)
    ix = warc.Index(where, shards)
    for k in range(167):
        assert sorted(x[2] for x in ix.find(f"k{k:04d}")) == [i for i in range(3 * k, 3 * k + 3) if i < 500]
    assert not list(ix.find("a")) and not list(ix.find("k0001x")) and not list(ix.find("z"))


def test_record_is_readable(spark):
    where = new_dir(spark, "warc")
    df = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>")], "page_id long, url string, html string")
    caps = warc.write_archives(df, where).collect()
    fs, path = store(where)
    for c in caps:
        with fs.open_input_file(f"{path}/{c.archive}") as f:
            raw = gzip.decompress(f.read_at(c.length, c.offset))
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    bad = warc.warc_record(1, "u", b"abc", None, "d").replace(b"abc", b"abd")
    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(bad))


def test_media_query(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op3_media_columns(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        p = docs[r.doc_id] + b"\xff" * ((-len(docs[r.doc_id])) % 576 or 576 * (not docs[r.doc_id]))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        m = media.encode_png(p)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(m), hashlib.sha256(m).hexdigest(), media.feature(p)) and media.decode_png(m) == p


def plain_feature(p):
    """With plain sums: is the mean of each 64th above the mean of all; mean and variance in thousandths, rounded down."""
    from fractions import Fraction
    from math import floor

    n = len(p)
    mean = Fraction(sum(p), n)
    bits = "".join(str(int(Fraction(sum(p[k * n // 64 : (k + 1) * n // 64]) * 64, n) > mean)) for k in range(64))
    spread = Fraction(sum(x * x for x in p), n) - mean * mean
    return f"{int(bits, 2):016x}-{floor(1000 * mean)}-{floor(1000 * spread)}"


def test_stored_form_by_other_readers(spark):
    """Archives by tarfile, images by Java's reader, features by plain sums."""
    import tarfile

    texts = {1: "a text, " * 300, 2: "", 3: None, 4: "é" * 1000}
    where = new_dir(spark, "media")
    media.write_archives(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2), where)
    path, found, jvm = store(where)[1], {}, spark._jvm
    import glob

    for f in glob.glob(f"{path}/*.tar"):
        with tarfile.open(f) as tar:
            for m in tar.getmembers():
                found[int(m.name.removesuffix(".png"))] = tar.extractfile(m).read()
    got = {r.doc_id: r for r in media.media_features(media.read_archives(spark, where)).collect()}
    assert sorted(found) == sorted(got) == [1, 2, 3, 4]
    for i, png in found.items():
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(png))
        data = bytes(image.getData().getDataBuffer().getData())
        raw = (texts[i] or "").encode()
        assert data == raw + b"\xff" * (len(data) - len(raw)) and len(data) == image.getWidth() * image.getHeight() and len(data) - len(raw) <= 576
        assert got[i].feature == plain_feature(data) and got[i].payload_sha256 == hashlib.sha256(data).hexdigest()


def test_partitions_are_bounded_and_strays_unread(spark):
    where = new_dir(spark, "media")
    df = spark.createDataFrame([(i, "text " * i) for i in range(200)], "doc_id long, text string").withColumn("media", F.lit(1)).repartition(9)
    assert media.write_archives(df, where) == 200
    names = sorted(r.name for r in media.read_archives(spark, where).collect())
    for most, least in ((1, 1), (4, 1), (50, 200)):
        read = media.read_archives(spark, where, rangeBytes=least, maxRanges=most)
        assert read.rdd.getNumPartitions() <= 2 * most + 1 and sorted(r.name for r in read.collect()) == names
    fs, path = store(where)
    with fs.open_output_stream(f"{path}/part-000000-999.tar") as out:  # of a task that didn't finish
        out.write(b"x" * 700)
    assert sorted(r.name for r in media.read_archives(spark, where).collect()) == names
    assert media.media_round_trip(spark, df.limit(0)).count() == 0


def test_media_ranges_sidecars_and_faults(spark):
    where = new_dir(spark, "media")
    df = spark.createDataFrame([(i, None if i == 3 else "t" * (i * 400)) for i in range(40)] + [(None, ""), (4, "x")], "doc_id long, text string").withColumn("media", F.lit(1))
    assert media.write_archives(df.coalesce(2), where) == 42
    fs, path = store(where)
    whole = media.read_archives(spark, where, rangeBytes=1500)
    assert whole.rdd.getNumPartitions() > 10
    names = sorted(r.name for r in whole.collect())
    assert len(names) == 42 and names.count("4.png") == 2 and names.count("null.png") == 1
    one = next(f.path for f in fs.get_file_info(media.pafs.FileSelector(path)) if f.base_name.endswith(".tar"))
    with fs.open_input_file(one + ".offsets") as f:
        offsets = np.frombuffer(f.read(), dtype="<i8").reshape(-1, 2)
    for f in [f.path for f in fs.get_file_info(media.pafs.FileSelector(path)) if f.base_name.endswith(".offsets")]:
        fs.delete_file(f)
    assert sorted(r.name for r in media.read_archives(spark, where, rangeBytes=1500).collect()) == names  # by walking headers
    with open(one, "r+b") as f:
        f.seek(int(offsets[2, 0]) + 148)
        f.write(b"zzzzzz")
    with pytest.raises(Exception, match="offset|at "):
        media.read_archives(spark, where, retries=0).collect()


def test_member_faults_are_rows_and_retries_count(spark, tmp_path):
    where = f"file://{tmp_path}"
    df = spark.createDataFrame([(i, "text") for i in range(6)], "doc_id long, text string").coalesce(1)
    media.write_archives(df, where)
    tar = next(tmp_path.glob("*.tar"))
    offsets = np.fromfile(f"{tar}.offsets", dtype="<i8").reshape(-1, 2)
    with open(tar, "r+b") as f:
        f.seek(int(offsets[2, 0]) + 148)
        f.write(b"zzzzzz")
    got = media.read_archives(spark, where, retries=1, onError="row").collect()
    assert len(got) == 6 and [r.offset for r in got if r.error] == [offsets[2, 0]]
    assert media.media_features(spark.createDataFrame([], "name string, media binary")).count() == 0
