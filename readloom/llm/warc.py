"""WARC archives with a two-level capture index.

``write_archives`` writes each page as a gzip member of a WARC 1.1 file in the shared folder and returns its captures:
index key, archive, offset and length. Of pages with equal payloads, the one with the smallest id is a response and the
others are revisits that refer to it.

``build_index`` sorts the captures by key (reversed-host URL, then page id) and place, cuts them into compressed blocks
of ``BLOCK_LINES`` lines, and keeps beside each shard a sparse directory with the first key, offset and length of each
block. ``lookup`` finds captures by key: it bisects the shards' bounds and their directories for the blocks that can hold
a key, then reads each such block by its byte range and bisects the lines. A key that many captures share fills many
blocks, over several shards, and those are dealt to tasks one by one. ``read_records`` reads captures by byte range,
neighbours in one request.

Files are named by task attempt and only those that a finished task has returned are referred to, so a lost executor
leaves stray files but no wrong rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flush_rows, materialise, new_dir, rows_of, store, surt, task_ids

#: Payloads that pages share, of which a table is broadcast at most (some 30 MB): the commonest ones. The others are joined by a shuffle.
MAX_BROADCAST = 300_000
BLOCK_LINES = 1000
#: Byte ranges of one archive that lie this near are read in one request, up to this many bytes in all.
GAP, SPAN = 64 << 10, 8 << 20

_CAPTURE = pa.schema([("key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_CAPTURE_SQL = "key string, archive string, offset long, length long"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def capture_key(url: str | None, page_id: int | None) -> str:
    """The index key. Ids are offset and zero-padded so that text order is numeric order; a null id sorts first."""
    return f"{_CONTROL.sub('_', surt(url))} " + ("" if page_id is None else f"{page_id + 2**63:020d}")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(digest, size, refers_to, n): payloads of at least ``min_bytes`` that more than one row has, with their smallest page_id.

    Only digests are shuffled, pre-aggregated.
    """
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return (
        pages.select("page_id", F.sha1(raw).alias("digest"), F.octet_length(raw).alias("size")).where(F.col("size") >= min_bytes)
        .groupBy("digest", "size").agg(F.min(F.col("page_id").cast("long")).alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def write_archives(pages: DataFrame, directory: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write all rows of ``pages`` (page_id, url, html) and return their captures (key, archive, offset, length).

    A null html is an empty payload. Rows that share the smallest id of their payload are all responses; a payload whose
    rows have no id is a response in each. Rows whose payload is among the commonest are written without a shuffle.
    """
    twins = materialise(revisits(pages, min_bytes), "revisits")
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    wanted = ["page_id", "url", "payload", "refers_to"]
    if twins.count() <= MAX_BROADCAST:
        joined = keyed.join(F.broadcast(twins), ["digest", "size"], "left").select(*wanted)
    else:  # without the commonest, no payload is left that could crowd a task
        common = materialise(twins.orderBy(F.desc("n"), "digest", "size").limit(MAX_BROADCAST), "common").select("digest", "size", "refers_to")
        rest = twins.join(F.broadcast(common), ["digest", "size"], "left_anti").select("digest", "size", "refers_to")
        near = keyed.join(F.broadcast(common), ["digest", "size"]).select(*wanted)
        joined = near.unionByName(keyed.join(F.broadcast(common), ["digest", "size"], "left_anti").join(rest, ["digest", "size"], "left").select(*wanted))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = task_ids()
        name = f"part-{part:06d}-{attempt}.warc.gz"
        fs, path = store(directory)
        fs.create_dir(path, recursive=True)

        def captures() -> Iterator[tuple]:
            at = 0
            with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
                for b in batches:
                    for page_id, url, payload, first in rows_of(b, "page_id", "url", "payload", "refers_to"):
                        refers = first if first is not None and first != page_id else None
                        record = gzip.compress(warc_record(page_id, url, payload, refers, date), 6, mtime=0)
                        out.write(record)
                        yield capture_key(url, page_id), name, at, len(record)
                        at += len(record)

        yield from flush_rows(_CAPTURE, captures())

    return materialise(joined.mapInArrow(write, _CAPTURE_SQL), "captures")


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record (HTTP headers only) where ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url or 'about:blank')}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(member: bytes) -> dict:
    """Fields of a gzip member: page_id, record_type, refers_to, payload (None in a revisit), size and digest of the payload.

    The digest of a response is computed from the payload read, and must equal the recorded one.
    """
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda v: None if v in (None, "<urn:page:null>") else int(v[len("<urn:page:"):-1])
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: payload doesn't match its headers")
    return {"page_id": number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")),
            "payload": payload if response else None, "payload_bytes": size, "payload_digest": digest}


# --- the index -----------------------------------------------------------------------------------------------------


def build_index(captures: DataFrame, directory: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str, str]]:
    """Write the index shards; returns (first key, last key, shard) of each, a row per shuffle partition, in key order."""
    schema = pa.schema([("first", pa.string()), ("last", pa.string()), ("shard", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = task_ids()
        name = f"shard-{part:06d}-{attempt}"
        fs, path = store(directory)
        lines: list[str] = []
        sparse: list[str] = []
        at, first, last, out = 0, None, None, None

        def flush() -> None:
            nonlocal at
            packed = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))
            out.write(packed)
            sparse.append(json.dumps([lines[0].split("\t", 1)[0], at, len(packed)]))
            at += len(packed)
            lines.clear()

        for b in batches:
            for key, archive, offset, length in rows_of(b, *_CAPTURE.names):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out, first = fs.open_output_stream(f"{path}/{name}.idx", compression=None), key
                lines.append(f"{key}\t{archive}\t{offset}\t{length}")
                last = key
                if len(lines) >= block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with fs.open_output_stream(f"{path}/{name}.dir", compression=None) as o:
            o.write("\n".join(sparse).encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (first, last, name)], schema=schema)

    order = ["key", "archive", "offset"]  # the place as well, so that a key that many rows share is spread
    laid = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted(tuple(r) for r in laid.mapInArrow(write, "first string, last string, shard string").collect())


class Index:
    """A reader of the shards in ``directory``; holds one shard's directory and one block at a time."""

    def __init__(self, directory: str, shards: list[tuple[str, str, str]]):
        self.fs, self.path = store(directory)
        self.shards = shards
        self.lasts = [s[1] for s in shards]
        self.name = self.block = None

    def _open(self, name: str) -> None:
        if name != self.name:
            with self.fs.open_input_file(f"{self.path}/{name}.dir") as f:
                self.sparse = [json.loads(x) for x in f.read().decode("utf-8", "surrogatepass").split("\n")]
            self.firsts = [x[0] for x in self.sparse]
            self.name = name

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(shard, offset, length) of the blocks that can hold a key, from the bounds and directories alone."""
        s = bisect_left(self.lasts, key)
        while s < len(self.shards) and self.shards[s][0] <= key:
            self._open(self.shards[s][2])
            k = max(0, bisect_left(self.firsts, key) - 1)
            while k < len(self.sparse) and self.firsts[k] <= key:
                yield self.name, *self.sparse[k][1:]
                k += 1
            s += 1

    def lines(self, shard: str, at: int, length: int, key: str) -> Iterator[tuple[str, str, int, int]]:
        """The captures of a key in a block. The block stays for the next key."""
        if self.block is None or self.block[0] != (shard, at):
            with self.fs.open_input_file(f"{self.path}/{shard}.idx") as f:
                lines = [x.split("\t") for x in zlib.decompress(f.read_at(length, at)).decode("utf-8", "surrogatepass").split("\n")]
            self.block = (shard, at), [x[0] for x in lines], lines
        _, keys, lines = self.block
        for i in range(bisect_left(keys, key), bisect_right(keys, key)):
            yield key, lines[i][1], int(lines[i][2]), int(lines[i][3])

    def find(self, key: str) -> Iterator[tuple[str, str, int, int]]:
        """All captures of a key."""
        for shard, at, length in self.blocks(key):
            yield from self.lines(shard, at, length, key)


def lookup(keys: DataFrame, directory: str, shards: list[tuple[str, str, str]]) -> DataFrame:
    """The captures of each distinct key of ``keys`` (column key); null keys and keys without a capture give no row.

    The distinct keys are range-sorted, so each task walks a run of directories in order; then the blocks they lead to
    are dealt out, so that a block is read once and no task has more of a key than a block's lines. ``shards`` has a row
    per shuffle partition of the index, so what tasks are sent is bounded by the partition count.
    """
    schema = pa.schema([("shard", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("key", pa.string())])

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(directory, shards)
        yield from flush_rows(schema, ((*block, key) for b in batches for key in b.column("key").to_pylist() for block in index.blocks(key)))

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(directory, shards)
        yield from flush_rows(_CAPTURE, (c for b in batches for row in rows_of(b, *schema.names) for c in index.lines(*row)))

    once = materialise(keys.select("key").where("key IS NOT NULL").distinct(), "keys")
    found = once.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(which, "shard string, at long, size long, key string")
    return found.repartition("shard", "at").sortWithinPartitions("shard", "at", "key").mapInArrow(captures, _CAPTURE_SQL)


def read_ranges(fs, path: str, wanted: Iterable[tuple[str, int, int]]) -> Iterator[bytes]:
    """The bytes of each (archive, offset, length), in order; near neighbours of one archive share a request."""
    group: list[tuple[str, int, int]] = []

    def fetch() -> Iterator[bytes]:
        base = group[0][1]
        with fs.open_input_file(f"{path}/{group[0][0]}") as f:
            data = f.read_at(max(o + n for _, o, n in group) - base, base)
        for _, o, n in group:
            yield data[o - base : o - base + n]

    for w in wanted:
        if group and (w[0] != group[-1][0] or w[1] < group[0][1] or w[1] > group[-1][1] + group[-1][2] + GAP or w[1] + w[2] - group[0][1] > SPAN):
            yield from fetch()
            group = []
        group.append(w)
    if group:
        yield from fetch()


def read_records(captures: DataFrame, directory: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each capture, read from its byte range."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(directory)
        wanted = (w for b in batches for w in rows_of(b, "archive", "offset", "length"))
        records = map(parse_record, read_ranges(fs, path, wanted))
        yield from flush_rows(schema, (tuple(r[n] for n in schema.names) for r in records))

    laid = captures.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return laid.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def page_keys(pages: DataFrame) -> DataFrame:
    """The index key of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, i) for u, i in rows_of(b, "url", "page_id")], pa.string())], names=["key"])

    return pages.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id")).mapInArrow(run, "key string")


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives, index them, look every page up by its key and read its record back.

    One row per input row: repeated rows are repeated, rows without url and id share a key and are found each. Null and
    empty html is an empty payload; payloads of any length are read whole. An empty table gives no row; columns other
    than page_id, url and html aren't read.
    """
    archives, index = new_dir(spark, "warc"), new_dir(spark, "warc-index")
    captures = write_archives(pages, archives, min_bytes)
    shards = build_index(captures, index)
    return read_records(lookup(page_keys(pages), index, shards), archives)
