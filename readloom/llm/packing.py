"""Packing: concatenate and cut.

Every document is its token ids and then the separator id. All documents make one stream, in the order of their files'
names and of the rows in each, however files are listed or split; rows that come from no file follow their partitions.
The stream is cut every ``LENGTH`` ids. Two passes: the first tokenises once and stores the ids with their offset in
their run, the rows of one split of a file; the second turns the runs' totals into global offsets by a prefix sum, after
which every document knows the windows that it crosses. Whole sequences are assembled in place where a task holds all of a window, and only boundary records (the pieces
of windows that partitions share) are shuffled. Pieces are read off the stored sequences.

Token ids are those of a ``tokenizers`` file. A byte-level BPE vocabulary whose ids are its merge ranks gives the same
ids through ``tiktoken``, at several times the speed; texts with characters beyond the ranges where the two agree on
letters and white space for certain, texts with a long run of white space, on which ``tiktoken`` panics, texts
that hold an added token's string, and other vocabularies go through ``tokenizers``.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, task_ids

LENGTH = 1024
SEPARATOR = 0
VOCABULARY = "byte_bpe_50k.json"
# The pattern by which byte-level BPE vocabularies cut a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How stored ids are compressed.
COMPACT = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
#: Ids in an output batch of stored tokens.
BATCH_IDS = 1 << 20
#: White-space characters in a row that ``tiktoken`` isn't given: its pattern's backtracking overflows somewhat below 1,000,000.
LONG_BLANK = 100_000
#: A piece as sequences store it: document, whether that is null, first id, count, the document's ids, offset.
_SPAN = "<6q"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts, as little-endian unsigned 16-bit bytes (or 32-bit for a vocabulary beyond 65,536 ids)."""

    #: Characters outside ASCII text, Latin and Cyrillic letters and common typographic marks.
    _RARE = re.compile("[^\t\n\r -~\u00a1-\u024f\u0400-\u045f\u2010-\u2027\u2030-\u203e]")
    #: Tried at the start of each run only, so that runs cost no more than their length.
    _BLANK = re.compile(rf"(?<!\s)\s{{{LONG_BLANK}}}")

    def __init__(self, path: str, special: bool = False):
        """With ``special``, an added token's string in a text is that token, as by a plain ``encode``; else ordinary text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if special and added else None
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        """The ``tiktoken`` encoding of a byte-level BPE file, or None where ids aren't ranks or it has another form."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut, model, byte = spec.get("pre_tokenizer") or {}, spec["model"], _byte_of()
        if spec.get("normalizer") or model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return None
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        joined = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if joined != sorted(joined) or len(ranks) != 256 + len(set(joined)):
            return None
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or self._RARE.search(text) or (len(text) >= LONG_BLANK and self._BLANK.search(text)) or (self.added and self.added.search(text)):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, kept for later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, special=True)
    return _ENCODERS[path]


def tokens(docs: DataFrame, path: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """(file, block, part, start, n, doc_id, ids): every document's ids with the separator, stored once in the shared folder.

    ``file``, ``block`` and ``part`` name the run of a row; ``start`` counts the ids before it there. A null text is empty
    and has the separator alone. Spark's scan keeps the order of rows in a split, so a repeated task stores the same.
    """
    path = path or vocabulary_path()
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, _ = task_ids()
        enc = encoder(path)
        size, end = enc.kind.itemsize, np.array([separator], dtype=enc.kind).tobytes()
        at: dict[tuple[str, int], int] = {}
        held, ids = [], 0
        for b in batches:
            for file, block, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("file", "block", "doc_id", "text")), strict=True):
                got = enc.encode(text) + end
                n = len(got) // size
                start = at.get((file, block), 0)
                held.append((file, block, part, start, n, doc_id, got))
                at[file, block], ids = start + n, ids + n
                if ids >= BATCH_IDS:
                    yield _rows(schema, held)
                    held, ids = [], 0
        if held:
            yield _rows(schema, held)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    try:
        rows = docs.select(F.input_file_name().alias("file"), F.input_file_block_start().cast("long").alias("block"), *columns)
    except AnalysisException:  # of several tables, where a row has no one file
        rows = docs.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), *columns)
    return materialise(rows.mapInArrow(run, "file string, block long, part int, start long, n long, doc_id long, ids binary"), "tokens", **COMPACT)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def run_offsets(stored: DataFrame) -> tuple[dict[tuple[str, int, int], int], int]:
    """The ids before each run and the ids in all: a prefix sum over one total per split of a file, or per partition."""
    run = ["file", "block", "part"]
    totals = stored.groupBy(*run).agg(F.max(F.col("start") + F.col("n")).alias("n")).collect()
    out, at = {}, 0
    for key, n in sorted((tuple(r[c] for c in run), r["n"]) for r in totals):
        out[key] = at
        at += n
    return out, at


def _cuts(start: int, n: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first id, count, sequence, offset) of the pieces of a document that starts at this place of the stream."""
    at = 0
    while at < n:
        sequence, offset = divmod(start + at, length)
        count = min(n - at, length - offset)
        yield at, count, sequence, offset
        at += count


def width(path: str) -> np.dtype:
    return encoder(path).kind


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document.

    The sequences are assembled and stored in the shared folder, and each piece is cut from its sequence. Null and empty
    texts are their separator; texts of any length are packed whole, whatever they hold. Repeated rows are packed as often
    as they occur, null ids like others; an empty table gives no piece; columns other than doc_id and text aren't read.
    The ids' checksum is over little-endian unsigned 32-bit ids.
    """
    path = path or vocabulary_path()
    packed = materialise(sequences(tokens(docs, path, separator), path, length, separator, spans=True)[0], "sequences", **COMPACT)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = width(path)
        for b in batches:
            out = []
            for sequence, raw, spans in zip(*(b.column(c).to_pylist() for c in ("sequence_id", "ids", "spans")), strict=True):
                ids = memoryview(np.frombuffer(raw, dtype=kind).astype("<u4")).cast("B")
                for doc_id, null, start, count, n, offset in struct.iter_unpack(_SPAN, spans):
                    crc = zlib.crc32(ids[4 * offset : 4 * (offset + count)])
                    out.append((None if null else doc_id, start, count, crc, n, sequence, offset))
            if out:
                yield _rows(schema, out)

    return packed.select("sequence_id", "ids", "spans").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def sequences(stored: DataFrame, path: str, length: int = LENGTH, pad: int = SEPARATOR, spans: bool = False) -> tuple[DataFrame, int]:
    """(sequence_id, n, ids) of every window of the stream of :func:`tokens`, and how many there are.

    With ``spans``, a binary column of that name has the window's pieces, in order.

    ``ids`` has ``length`` ids: the last window is padded, unless its own length is a power of two. Windows that lie in
    one task's run of documents are emitted at once. Those that runs share come as boundary records, which a shuffle
    joins by window: at most two records per run and no more ids than a window has, however long documents are.
    """
    before, total = run_offsets(stored)
    last = (total - 1) // length
    kind = width(path)
    data = ["ids", "spans"] if spans else ["ids"]
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in data)])

    def cut(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            held: list[bytes] = []
            within: list[bytes] = []
            window, begin, have = -1, 0, 0

            def close() -> None:
                if have and (have == (total - last * length if window == last else length)) == whole:
                    out.append((window, begin, have, b"".join(held), *([b"".join(within)] if spans else [])))

            for b in batches:
                columns = [b.column(c).to_pylist() for c in ("file", "block", "part", "start", "n", "ids")]
                columns.append(b.column("doc_id").to_pylist() if spans else [None] * b.num_rows)
                for *run_of, start, n, raw, doc_id in zip(*columns, strict=True):
                    for at, count, sequence, offset in _cuts(before[tuple(run_of)] + start, n, length):
                        if sequence != window or offset != begin + have:
                            close()
                            window, begin, have, held, within = sequence, offset, 0, [], []
                        held.append(raw[at * kind.itemsize : (at + count) * kind.itemsize])
                        if spans:
                            within.append(struct.pack(_SPAN, doc_id or 0, doc_id is None, at, count, n, offset))
                        have += count
                    if len(out) >= 1000:
                        yield _rows(schema, out)
                        out = []
            close()
            if out:
                yield _rows(schema, out)

        read = stored.select("file", "block", "part", "start", "n", "ids", *(["doc_id"] if spans else []))
        return read.mapInArrow(run, "sequence_id long, offset int, n int, " + ", ".join(f"{c} binary" for c in data))

    shared = cut(False).groupBy("sequence_id").agg(F.sum("n").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("offset", *data))).alias("p"))
    # binary pieces are joined as hexadecimal text, the only form that SQL can reduce
    joined = [F.unhex(F.array_join(F.transform(F.col("p")[c], F.hex), "")).alias(c) for c in data]
    every = cut(True).select("sequence_id", "n", *data).unionByName(shared.select("sequence_id", "n", *joined))
    rest = total - last * length
    if total and rest & (rest - 1):
        blank = F.unhex(F.repeat(F.lit(np.array([pad], dtype=kind).tobytes().hex()), F.lit(length) - F.col("n")))
        every = every.withColumn("ids", F.when(F.col("n") < length, F.concat("ids", blank)).otherwise(F.col("ids")))
    return every, last + 1
