"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary-trie self-join.

A fingerprint's bit is set where it is set in over half of the shingle hashes (repeats included). Documents link where
their fingerprints differ in at most ``MAX_BITS`` bits, and components are the connected sets of those links.

Copies first collapse to one row per fingerprint, so groups of equal texts never meet. Two fingerprints within three
bits agree on one of four 16-bit bands, so the binary trie over a band's 16 bits followed by the other 48 holds any
such pair below one node of depth 16. Those subtries are the units of work: each is joined with itself by walking node
pairs together from the top, a level at a time for all pairs at once; a pair of nodes carries the bits it differs in
so far and is dropped beyond the error budget. A crowded subtrie (over ``CROWD`` fingerprints) is split: up to ``CHUNKED``
fingerprints, into chunks of which each two are joined as tries, at most ``CHUNKED / CROWD`` rows per fingerprint;
beyond that, on the same principle as before, by four bands of the bits that are left. Fingerprints are distinct, so a
subtrie with r bits left has no more than 2 ** r of them and the splitting ends. No task ever holds an unbounded group,
rows never grow with the square of one, and no link is lost. A unit yields a spanning forest of its links, at most one
per fingerprint, never all of its pairs.

Components come from the forests by rounds of star contraction on tables, cut by ``materialise``.

Fingerprints of three-word shingles within three bits find few of the pairs that share 0.8 of their shingles of five words.
For those, :func:`similar` joins two fingerprints of words, by the logarithms of their counts, in the same way within four
bits, which most such pairs keep to, and keeps the links whose sketches of five-word shingles agree. Many different texts
can share one such fingerprint, and a crowd of near copies keeps together in every band. So the members of crowded bands
are first held against some of them (:func:`led`); of the clusters that come of it no two members are compared again, but
all others are with each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialise, sized

MAX_BITS = 3
#: Differing bits of similar texts' fingerprints of words.
WORD_BITS = 4
SHINGLE = 3
SEED = 42
#: Fingerprints in one subtrie that a task joins as a whole.
CROWD = 1024
#: Fingerprints in a chunk that isn't joined with itself.
WIDE = 16 * CROWD
#: Fingerprints in one subtrie that are joined by pairs of chunks.
CHUNKED = 64 * CROWD
#: Node pairs of a trie join that are expanded at once (some 100 MB), and pairs of keys below which they aren't expanded further.
FRONT = 200_000
LEAF = 16
#: Rows of two longs that are broadcast at most (some 32 MB).
MAX_BROADCAST = 1_000_000
#: Shingles of a text that are hashed at once.
BLOCK = 100_000
#: Of similar texts: shingles of so many words, the share that they have in common, and by how much an estimate may fall short.
WORDS, SIMILAR, MARGIN = 5, 0.8, 0.025
#: Hash minima in a sketch (an estimate's standard error is 0.025 at 0.8), and equal bits of the 64 of their fingerprints.
MINIMA, BESIDE = 256, 50
#: Members of a crowd that all of them are held against, on average, and members that are at once.
LEADERS, LED = 64, 4096
#: Shingles whose minima are taken at once, and words whose hashes a worker remembers.
STRIP, REMEMBERED = 4096, 1_000_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(raw: bytes | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text; zero without a word."""
    words = (raw or b"").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, BLOCK):  # blocks bound the memory of very long texts
        here = words[i : i + BLOCK + width - 1]
        grams = map(b" ".join, zip(*(here[k:] for k in range(width)), strict=False)) if n > 1 else [b" ".join(here)]
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.nonzero(2 * ones > n)[0].tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp: longs) of every row; fp holds the unsigned fingerprint's bits, h is a hash of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("raw").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fp)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, h long, fp long")


# --- the trie join, on sorted arrays -------------------------------------------------------------------------------


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = parent[up]


def _forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of (a, b) that join components, and ``parent`` updated; vectorised hooking to the smaller root."""
    kept_a, kept_b = [], []
    while len(a):
        ra, rb = _find(parent, a), _find(parent, b)
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        if not len(a):
            break
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        roots, first = np.unique(high, return_index=True)  # each root hooks once, always onto a smaller one
        parent[a], parent[b] = ra, rb
        parent[roots] = low[first]
        kept_a.append(a[first])
        kept_b.append(b[first])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(kept_a), np.concatenate(kept_b)) if kept_a else (none, none)


def _nearest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of a spanning forest that prefers those of the least ``far``, and that of each.

    ``levels`` gets the components by links of ``far`` below 3, below 6 and so on, in its rows from 1.
    """
    parent, out = np.arange(n), [(a[:0], b[:0], far[:0])]
    for d in range(65 - BESIDE):
        here = far == d
        if here.any():
            x, y = _forest(n, a[here], b[here], parent)
            out.append((x, y, np.full(len(x), d, dtype=far.dtype)))
        if levels is not None and d % 3 == 2:
            levels[(d + 1) // 3] = _find(parent, np.arange(n))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pairs(front: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The index pairs of pairs of ranges, about ``FRONT`` at once; of a range with itself each pair once."""
    step = np.maximum(1, FRONT // (front[:, 3] - front[:, 2]))
    cuts = -(-(front[:, 1] - front[:, 0]) // step)
    row = np.repeat(np.arange(len(front)), cuts)
    a0 = front[row, 0] + (np.arange(len(row)) - np.repeat(cuts.cumsum() - cuts, cuts)) * step[row]
    b0, high = front[row, 2], (front[:, 3] - front[:, 2])[row]
    many = (np.minimum(a0 + step[row], front[row, 1]) - a0) * high
    other = (front[:, 0] != front[:, 2])[row]
    edge = np.flatnonzero(np.diff((many.cumsum() - many) // FRONT)) + 1
    for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(row)], strict=True):
        at = np.repeat(np.arange(lo, hi), many[lo:hi])
        k = np.arange(len(at)) - np.repeat(many[lo:hi].cumsum() - many[lo:hi], many[lo:hi])
        a, b = a0[at] + k // high[at], b0[at] + k % high[at]
        once = (a < b) | other[at]
        yield a[once], b[once]


def trie_links(keys: np.ndarray, roots: list[tuple[int, int, int, int]], bits: int = 64, budget: int = MAX_BITS,
               beside: np.ndarray | None = None, other: np.ndarray | None = None, apart: tuple[tuple[int, int], ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of the links between keys within ``budget`` bits.

    ``keys``: unsigned; sorted within each range. ``roots``: pairs of ranges (a_lo, a_hi, b_lo, b_hi) that are joined,
    equal for a self-join. A trie node is a range of keys that share a prefix; its children are found by a binary
    search for the next bit. Node pairs are walked depth first in blocks of ``FRONT``, so memory stays bounded.

    With ``beside``, a second word of each key, a link needs ``BESIDE`` equal bits of those at least too, and the forest
    prefers links that differ least there. With ``other``, a link needs more than ``budget`` differing bits of those. Links need
    a differing bit in each of the bands ``apart`` (lowest bit and mask).
    """
    n = len(keys)
    parent = np.arange(n)
    out_a, out_b, out_far = [], [], []
    held = settled = 0
    levels = None

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal held, settled, levels
        if beside is None:
            a, b = _forest(n, a, b, parent)
        else:
            far = np.bitwise_count(beside[a] ^ beside[b])
            near = far <= 64 - BESIDE
            if levels is not None:  # nearer links join them already
                near[near] = levels[(far[near] + 1) // 3, a[near]] != levels[(far[near] + 1) // 3, b[near]]
            a, b = a[near], b[near]
            out_far.append(far[near])
        out_a.append(a)
        out_b.append(b)
        held += len(a)
        if beside is not None and held > settled + FRONT // 2:  # what a part's forest leaves out, the whole one does
            if levels is None:
                levels = np.tile(np.arange(n), ((65 - BESIDE) // 3 + 1, 1))
            got = _nearest(n, *map(np.concatenate, (out_a, out_b, out_far)), levels)
            for kept, now in zip((out_a, out_b, out_far), got, strict=True):
                kept[:] = [now]
            held = settled = len(got[0])

    start = np.array(roots, dtype=np.int64).reshape(-1, 4)
    stack = [(bits - 1, start, np.zeros(len(start), dtype=np.int8))]
    while stack:
        bit, front, used = stack.pop()
        if len(front) > FRONT:
            half = len(front) // 2
            stack += [(bit, front[half:], used[half:]), (bit, front[:half], used[:half])]
            continue
        for low, mask in apart:
            if bit == low - 1:
                differ = ((keys[front[:, 0]] ^ keys[front[:, 2]]) >> np.uint64(low)) & np.uint64(mask) != 0
                front, used = front[differ], used[differ]
        wide, high = front[:, 1] - front[:, 0], front[:, 3] - front[:, 2]
        few = wide * high <= (LEAF if bit >= 0 or beside is None else np.inf)
        if few.any():  # few keys are left, or equal ones to compare further: the rest of the walk is a count of their differing bits
            for a, b in _pairs(front[few]):
                x = keys[a] ^ keys[b]
                near = np.bitwise_count(x) <= budget
                for low, mask in apart:
                    near &= (x >> np.uint64(low)) & np.uint64(mask) != 0
                a, b = a[near], b[near]
                if other is not None:
                    near = np.bitwise_count(other[a] ^ other[b]) > budget
                    a, b = a[near], b[near]
                keep(a, b)
            front, used = front[~few], used[~few]
        if not len(front):
            continue
        if bit < 0:  # equal keys below one leaf, or leaves within the budget: chain the ranges
            for a0, a1, b0, b1 in front.tolist():
                a, b = np.arange(a0, a1), np.arange(b0, b1)
                x, y = np.concatenate([a[:-1], b[:-1], a[:1]]), np.concatenate([a[1:], b[1:], b[:1]])
                keep(x[x != y], y[x != y])
            continue
        ranges = np.concatenate([front[:, :2], front[:, 2:]])
        nodes, back = np.unique(ranges[:, 0] * (n + 1) + ranges[:, 1], return_inverse=True)  # rows would be sorted far more slowly
        cut = _split(keys, np.stack([nodes // (n + 1), nodes % (n + 1)], axis=1), bit)[back]
        ma, mb = cut[: len(front)], cut[len(front):]
        a0, a1, b0, b1 = front.T
        same = (a0 == b0) & (a1 == b1)
        zero = np.stack([a0, ma, b0, mb], axis=1)
        one = np.stack([ma, a1, mb, b1], axis=1)
        cross = np.stack([a0, ma, mb, b1], axis=1)
        crossed = np.stack([ma, a1, b0, mb], axis=1)[~same]
        nxt = np.concatenate([zero, one, cross, crossed])
        use = np.concatenate([used, used, used + 1, used[~same] + 1])
        live = (use <= budget) & (nxt[:, 1] > nxt[:, 0]) & (nxt[:, 3] > nxt[:, 2])
        live &= ~((nxt[:, 0] == nxt[:, 2]) & (nxt[:, 1] == nxt[:, 3]) & (nxt[:, 1] - nxt[:, 0] == 1))
        stack.append((bit - 1, nxt[live], use[live]))
    none = np.zeros(0, dtype=np.int64)
    if beside is not None and out_a:
        return _nearest(n, *map(np.concatenate, (out_a, out_b, out_far)))[:2]
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _split(keys: np.ndarray, nodes: np.ndarray, bit: int) -> np.ndarray:
    """Where each node's range turns from 0 to 1 in this bit: a binary search in all ranges at once."""
    lo, hi = nodes[:, 0].copy(), nodes[:, 1].copy()
    mask = np.uint64(1) << np.uint64(bit)
    while (live := lo < hi).any():
        mid = (lo + hi) // 2
        one = np.zeros(len(lo), dtype=bool)
        one[live] = (keys[mid[live]] & mask) != 0
        hi = np.where(live & one, mid, hi)
        lo = np.where(live & ~one, mid + 1, lo)
    return lo


# --- links over all fingerprints -----------------------------------------------------------------------------------


def _whole_units(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of ``batches``, sorted by unit, in tables of whole units, of some ``rows`` at least but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        unit = t.column("unit").to_numpy()
        cut = int(np.argmax(unit == unit[-1]))
        if cut:
            yield t.slice(0, cut)
            held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def _join_units(units: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """Spanning links (u, v) of each unit within ``budget`` bits; ``units``: unit, side, fp, and where links are checked further node, beside, band and other.

    Side 0 is joined with itself, side 1 with side 2. u and v are fingerprints, or nodes. Rows arrive sorted by unit, and
    whole units are solved together in groups of some 200,000 rows, so a task's memory doesn't grow with its partition.
    Of checked links, one that several first bands have is left to the highest, one that the first family has to that.
    """
    width = 64 // (budget + 1)
    checked = "node" in units.columns
    kind, name = (pa.string(), "string") if checked else (pa.int64(), "long")
    schema = pa.schema([("u", kind), ("v", kind)])
    laid = units.repartition("unit").sortWithinPartitions("unit")

    def solve(t: pa.Table) -> pa.RecordBatch:
        unit, side, keys = (t.column(c).to_numpy() for c in ("unit", "side", "fp"))
        keys = keys.view(np.uint64)
        order = np.lexsort((keys, side, unit))
        unit, side, keys = unit[order], side[order], keys[order]
        edge = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (side[1:] != side[:-1]), True])
        lo, hi = edge[:-1], edge[1:]
        alone = (side[lo] == 0) & (hi - lo > 1)
        first = np.flatnonzero((side[lo[:-1]] == 1) & (side[lo[1:]] == 2) & (unit[lo[:-1]] == unit[lo[1:]])) if len(lo) > 1 else np.zeros(0, np.int64)
        roots = np.concatenate([
            np.stack([lo[alone], hi[alone], lo[alone], hi[alone]], axis=1),
            np.stack([lo[first], hi[first], lo[first + 1], hi[first + 1]], axis=1),
        ])
        if checked:
            beside, band, other = (t.column(c).to_numpy()[order] for c in ("beside", "band", "other"))
            found = [(np.zeros(0, np.int64),) * 2]
            for k in np.unique(band[roots[:, 0]]).tolist():
                second, j = divmod(k, 64)
                apart = tuple((width * i, (1 << width) - 1) for i in range(budget, j, -1))
                found.append(trie_links(keys, roots[band[roots[:, 0]] == k], budget=budget, beside=beside.view(np.uint64), other=other.view(np.uint64) if second else None, apart=apart))
            x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        else:
            x, y = trie_links(keys, roots, budget=budget)
        ids = t.column("node").combine_chunks().take(pa.array(order)) if checked else pa.array(keys.view(np.int64))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(x)).cast(kind), ids.take(pa.array(y)).cast(kind)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(solve, _whole_units(batches, 200_000))

    return laid.mapInArrow(run, f"u {name}, v {name}")


def _bands(rows: DataFrame, bits: int, budget: int = MAX_BITS) -> DataFrame:
    """unit, fp, rest of every row once per band: its unit with the value of one of the bands of ``rest``, and the other bits.

    ``rest`` has ``bits`` bits. Of one band more than ``budget``, two fingerprints that agree so far and differ in that
    many bits agree on one. A column band tells which, plus 64 for a family after the first, if there is a column family.
    """
    width = bits // (budget + 1)

    def band(j: int):
        low = width * j
        value = F.shiftrightunsigned("rest", low).bitwiseAND((1 << width) - 1)
        above = F.shiftleft(F.shiftrightunsigned("rest", low + width), low) if low + width < bits else F.lit(0).cast("long")
        which = [(F.lit(j) + F.when(F.col("family") > 1, 64).otherwise(0)).cast("long").alias("band")] if "family" in rows.columns else []
        return F.struct(F.xxhash64("unit", F.lit(j), value).alias("unit"), above.bitwiseOR(F.col("rest").bitwiseAND((1 << low) - 1)).alias("rest"), *which)

    kept = [c for c in rows.columns if c not in ("unit", "rest", "family")]
    named = ["_b.band"] if "family" in rows.columns else []
    return rows.select(*kept, F.explode(F.array(*[band(j) for j in range(budget + 1)])).alias("_b")).select("_b.unit", *kept, *named, "_b.rest")


def _crowds(rows: DataFrame) -> DataFrame:
    """The units of more than ``CROWD`` rows (unit, n: their rows).

    Where rows have a cluster, n is without the rows of the unit's largest one, which are m rows of the cluster top.
    """
    if "cluster" not in rows.columns:
        return rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    each = rows.groupBy("unit", "cluster").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.when(F.col("cluster").isNotNull(), F.struct("n", "cluster")))
    units = each.groupBy("unit").agg(F.sum("n").alias("n"), top.alias("top")).where(F.col("n") > CROWD)
    return units.withColumn("m", F.coalesce("top.n", F.lit(0).cast("long"))).select("unit", (F.col("n") - F.col("m")).alias("n"), "m", F.col("top.cluster").alias("top"))


def _in_chunks(rows: DataFrame) -> DataFrame:
    """Units of ``rows`` (unit, fp, n: its fingerprints) cut into chunks by hash, and one unit per pair of chunks.

    With m and top, the m rows of the cluster top have chunks of their own, which meet the others' but not each other.
    """
    kept = [c for c in rows.columns if c not in ("unit", "n", "m", "top", "cluster")]
    key = F.xxhash64(*[c for c in ("fp", "node") if c in kept])
    if "top" not in rows.columns:
        dealt = rows.withColumn("_k", F.ceil(F.col("n") / CROWD)).withColumn("_c", F.pmod(key, F.col("_k")))
        return dealt.withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))).select(
            F.xxhash64("unit", F.least("_c", "_d"), F.greatest("_c", "_d")).alias("unit"),
            F.when(F.col("_c") == F.col("_d"), 0).when(F.col("_c") < F.col("_d"), 1).otherwise(2).alias("side"), *kept)
    one = F.lit(1).cast("long")
    dealt = rows.withColumn("_top", F.coalesce(F.col("cluster") == F.col("top"), F.lit(False))).withColumn("_k", F.ceil(F.col("n") / CROWD)).withColumn("_t", F.ceil(F.col("m") / WIDE))
    dealt = dealt.withColumn("_c", F.pmod(key, F.greatest(F.when(F.col("_top"), F.col("_t")).otherwise(F.col("_k")), one)))
    upto = lambda n: F.slice(F.sequence(one - 1, F.greatest(n, one) - 1), 1, n.cast("int"))
    unit = lambda x, y, side: F.struct(F.xxhash64("unit", x, y).alias("unit"), side.alias("side"))
    met = lambda x, y, side: F.struct(F.xxhash64("unit", F.lit("top"), x, y).alias("unit"), F.lit(side).alias("side"))
    c, k, t = F.col("_c"), F.col("_k"), F.col("_t")
    others = F.transform(upto(k), lambda d: unit(F.least(c, d), F.greatest(c, d), F.when(c == d, 0).when(c < d, 1).otherwise(2)))
    return dealt.withColumn("_u", F.explode(
        F.when(F.col("_top"), F.transform(upto(k), lambda d: met(d, c, 2))).otherwise(F.concat(others, F.transform(upto(t), lambda d: met(c, d, 1))))
    )).select("_u.unit", "_u.side", *kept)


def links(unique: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """A spanning set of links (u, v), within ``budget`` bits, between the rows of ``unique``: distinct fingerprints (fp), or distinct nodes.

    With columns node and beside, links are between nodes and checked as :func:`trie_links` does; a column family (from 1) keeps
    fingerprints of several kinds apart, and other has those of the first family, whose links later ones leave to it. Rows of one cluster (null: of none) are known to be linked, and in crowded units those
    of the largest one aren't compared with each other. Two units whose keys hash alike are merely joined as one: links are tested on
    whole fingerprints.
    """
    checked = "node" in unique.columns
    compared = ["node", "beside", "band", "other"] if checked else []
    family = F.col("family").cast("long") if "family" in unique.columns else F.lit(1).cast("long")
    other = F.col("other") if "other" in unique.columns else F.lit(0).cast("long")
    more = [c for c in unique.columns if c == "cluster"]
    rows = unique.select(family.alias("unit"), "fp", *(["node", "beside", other.alias("other"), family.alias("family"), *more] if checked else []), F.col("fp").alias("rest"))
    bits, found = 64, []
    solved = lambda t: found.append(_join_units(t.select("unit", "side", "fp", *compared), budget))
    alone = lambda t: t.withColumn("side", F.lit(0))
    while True:
        rows, bits = _bands(rows, bits, budget), bits - bits // (budget + 1)
        crowds = materialise(_crowds(rows), f"crowds{bits}")
        if not crowds.take(1):
            solved(alone(rows))
            return reduce(DataFrame.unionByName, found)
        solved(alone(rows.join(crowds, "unit", "left_anti")))
        vast = crowds.where(F.col("n") > CHUNKED if bits >= 16 else F.lit(False)).select("unit")
        split = bool(vast.take(1))
        if split and checked:  # equal fingerprints of several nodes can't be split
            apart = rows.join(vast, "unit", "left_semi").groupBy("unit").agg(F.approx_count_distinct("fp").alias("n"))
            vast = materialise(apart.where(F.col("n") > CHUNKED).select("unit"), f"vast{bits}")
            split = bool(vast.take(1))
        chunked = crowds.join(vast, "unit", "left_anti") if split else crowds
        solved(_in_chunks(rows.drop("rest").join(chunked, "unit")))
        if not split:
            return reduce(DataFrame.unionByName, found)
        rows = materialise(rows.join(vast, "unit", "left_semi"), f"rest{bits}")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Alternates large-star and small-star contraction until the set of links stays the same. A hub's minimum is
    pre-aggregated and stored, so that the join on a hub's key has a plain exchange on either side, which adaptive
    execution can split. A round's tables are deleted once the next one's are written.
    """
    links = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    state = None
    while True:
        # large star: each larger neighbour of a node links to the node's smallest neighbour (itself included)
        near = both(links)
        least = materialise(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each smaller neighbour of a node, and the node, link to the smallest of them
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, links = links, materialise(small.where("u <> v").distinct(), "links")
        discard(before, least, low)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, h, fp), and every fingerprint with its group (fp, root, rep: the smallest doc_id that has it).

    Both are stored, as are the groups' minima below: a join on a fingerprint or group that holds a third of all rows
    then has a plain exchange on either side, which adaptive execution can split.
    """
    marks = materialise(fingerprints(docs), "fingerprints")
    unique = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "unique")
    linked = components(links(unique)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    return marks, materialise(unique.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "groups")


# --- similar texts -------------------------------------------------------------------------------------------------

_ODD = np.random.default_rng(SEED).integers(0, 2**63, MINIMA + WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)  # multiplication wraps, as is meant
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _votes(h: np.ndarray, weight: np.ndarray | None = None) -> int:
    """The 64-bit SimHash of hashes: bits that are set by over half of the weight."""
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), BLOCK):
        bits = np.unpackbits(h[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64) if weight is None else weight[i : i + BLOCK] @ bits.astype(np.int64)
    total = len(h) if weight is None else int(weight.sum())
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes of the runs of ``WORDS`` words, given the words' hashes; of fewer words, of the whole sequence."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, WORDS)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _mixed(out + hashes[k : n - width + 1 + k] * _ODD[MINIMA + k])
    return np.unique(out)


class Sketcher:
    """(two fingerprints of words, one of five-word shingles, minima of their hashes) of texts."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, raw: bytes | None) -> tuple[int, int, int, bytes]:
        words = (raw or b"").translate(_LOWER).split()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, SEED)
        hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        distinct, count = np.unique(hashes, return_counts=True)
        runs = shingles(hashes)
        least = np.full(MINIMA, 2**64 - 1, dtype=np.uint64)
        for i in range(0, len(runs), STRIP):
            least = np.minimum(least, (runs[i : i + STRIP, None] * _ODD[None, :MINIMA]).min(axis=0))
        sketch = _mixed(least).astype(np.uint8).tobytes()
        weight = np.rint(1024 * np.log1p(count)).astype(np.int64)  # a text's commonest words are those of many others
        return _votes(distinct, weight), _votes(_mixed(distinct + _ODD[-1]), weight), _votes(runs), sketch


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, node, fp1, fp2, beside, sketch) of every row; ``node`` is a digest of the four that follow it."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("node", pa.string()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("beside", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        for b in batches:
            got = [sketcher(t) for t in b.column("raw").to_pylist()]
            three = np.array([g[:3] for g in got], dtype=np.uint64).reshape(-1, 3)
            node = [hashlib.md5(w.tobytes() + g[3]).hexdigest() for w, g in zip(three, got, strict=True)]
            longs = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in three.T]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(node), *longs, pa.array([g[3] for g in got], pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, h long, node string, fp1 long, fp2 long, beside long, sketch binary")


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sketches, a row each, have an estimated similarity of ``SIMILAR``, less ``MARGIN``, or more."""
    equal = (x == y).mean(axis=1)  # a 256th of the others are equal by chance
    return (equal - 1 / 256) / (1 - 1 / 256) >= SIMILAR - MARGIN


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, MINIMA)


def alike(pairs: DataFrame) -> DataFrame:
    """The rows (u, v) of ``pairs`` (u, v, and their sketches a, b) whose estimated similarity is ``SIMILAR``, less ``MARGIN``, or more."""
    schema = pa.schema([("u", pa.string()), ("v", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _agree(_sketches(b.column("a")), _sketches(b.column("b")))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], schema=schema).filter(pa.array(near))

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u string, v string")


def led(keyed: DataFrame, sketched: DataFrame, budget: int) -> DataFrame | None:
    """Links (u, v) of alike sketches between the members of crowds and some of them; null without a crowd.

    ``keyed``: node, family, fp; ``sketched``: node, sketch. A node goes to the largest of its crowded bands. Some
    ``LEADERS`` of each crowd, by a hash, are held against all of its members, ``LED`` at once, so rows grow with the
    members. Of the links a spanning forest of each part is returned.
    """
    banded = _bands(keyed.select(F.col("family").cast("long").alias("unit"), "node", F.col("fp").alias("rest")), 64, budget).select("unit", "node")
    crowds = materialise(_crowds(banded), "crowds")
    if not crowds.take(1):
        return None
    largest = banded.join(crowds, "unit").groupBy("node").agg(F.max(F.struct("n", "unit")).alias("_m")).select("node", "_m.n", "_m.unit")
    part = lambda p, side: F.struct(F.xxhash64("unit", p).alias("unit"), F.lit(side).alias("side"))
    parts = F.ceil(F.col("n") / LED)
    every = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda p: part(p, 0))
    leads = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / LEADERS)) == 0
    own = F.array(part(F.pmod(F.xxhash64("node", F.lit(1)), parts), 1))
    dealt = largest.join(sketched, "node").withColumn("_p", F.explode(F.when(leads, F.concat(every, own)).otherwise(own)))
    laid = dealt.select("_p.unit", "_p.side", "node", "sketch").repartition("unit").sortWithinPartitions("unit", "side")
    schema = pa.schema([("u", pa.string()), ("v", pa.string())])

    def solve(t: pa.Table) -> pa.RecordBatch:
        unit, side, sketch = t.column("unit").to_numpy(), t.column("side").to_numpy(), _sketches(t.column("sketch"))
        parent, links = np.arange(len(unit)), [(np.zeros(0, np.int64),) * 2]
        edge = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            for i in range(lo, lo + int((side[lo:hi] == 0).sum())):
                near = lo + np.flatnonzero(_agree(sketch[i], sketch[lo:hi]))
                links.append(_forest(len(unit), np.full(len(near), i), near, parent))
        ids = t.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(x))).cast(pa.string()) for x in zip(*links, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(solve, _whole_units(batches, 2 * LED))

    return materialise(laid.mapInArrow(run, "u string, v string").where("u <> v"), "led")


def _clusters(ties: DataFrame) -> DataFrame | None:
    """(node, cluster) of the components of ``ties`` (u, v) that have more than ``CROWD`` members; null without one."""
    if ties.limit(CROWD).count() < CROWD:
        return None
    tied = components(ties).select("node", F.col("component").alias("cluster"))
    tied = tied.unionByName(tied.select(F.col("cluster").alias("node"), "cluster").distinct())
    large = materialise(tied.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("cluster"), "large")
    return tied.join(large, "cluster", "left_semi") if large.take(1) else None


def similar(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`grouped`, by links of texts that share ``SIMILAR`` of their five-word shingles: (doc_id, h, fp), (fp, root, rep).

    Each of the two fingerprints of words goes through the trie join. Its forests prefer links whose third
    fingerprint, of the shingles, differs least; the sketches of a link's ends then decide. At least nine of ten pairs of
    that similarity come to one group. ``fp`` is a text's node. In crowds, the links of :func:`led` come first.
    """
    marks = materialise(sketches(docs), "sketches")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.col(f"fp{k}").alias("fp"), F.col("fp1").alias("other")) for k in (1, 2)])).alias("_k")
    unique = materialise(marks.groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in ("fp1", "fp2", "beside", "sketch")]), "unique")
    by_kind = lambda t, *also: t.select("node", "beside", *also, kinds).select("node", "beside", *also, "_k.family", "_k.fp", "_k.other")
    ties = led(by_kind(unique), unique.select("node", "sketch"), WORD_BITS)
    known = None if ties is None else _clusters(ties)
    keyed = by_kind(unique) if known is None else by_kind(materialise(unique.select("node", "beside", "fp1", "fp2").join(known, "node", "left"), "known"), "cluster")
    found = links(keyed, WORD_BITS)
    found = materialise(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "candidates")
    side = lambda n, s: unique.select(F.col("node").alias(n), F.col("sketch").alias(s))
    near = alike(found.join(side("u", "a"), "u").join(side("v", "b"), "v"))
    linked = components(near if ties is None else near.unionByName(ties)).select("node", F.col("component").alias("root"))
    group = unique.select("node", "rep").join(linked, "node", "left").select(F.col("node").alias("fp"), F.coalesce("root", "node").alias("root"), "rep")
    return marks.select("doc_id", "h", F.col("node").alias("fp")), materialise(group, "groups")


# --- results -------------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id): every row with the smallest doc_id that its fingerprint's links reach.

    Null and empty texts have fingerprint zero and link like any other; texts of any length are read whole. Repeated rows
    each stay. Rows with a null id link others too; their component_id is null only where no member has an id. An empty
    table gives no row. Only doc_id and text are read.
    """
    marks, group = grouped(docs)
    least = materialise(group.groupBy("root").agg(F.min("rep").alias("component_id")), "minima")
    return marks.join(group.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, by=grouped) -> DataFrame:
    """The row of the smallest doc_id of each near-duplicate group, with all columns of ``docs``; one of repeated rows.

    ``by`` finds the groups: :func:`grouped` or :func:`similar`. A row is known by its id and a hash of its text. Null and
    empty texts are one group; of rows with a null id one stays where no other has an id. An empty table gives none.
    Columns may have any names. The rows that go are few beside the texts, so they are broadcast up to ``MAX_BROADCAST``;
    beyond it the join is shuffled.
    """
    marks, group = by(docs)
    pairs = materialise(
        marks.groupBy("doc_id", "h", "fp").agg(F.count(F.lit(1)).alias("n")).join(group.select("fp", "root"), "fp"), "pairs")
    first = materialise(pairs.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "h")).alias("first")), "firsts")
    judged = materialise(pairs.join(first, "root").select(
        "doc_id", "h", "n", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))).alias("stays")), "judged")
    names = docs.columns
    i, h = fresh(names, "_id"), fresh(names, "_hash")
    keyed = docs.withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64("text")})

    def match(few: DataFrame, how: str) -> DataFrame:
        few = few.select(F.col("doc_id").alias("_a"), F.col("h").alias("_b"))
        return keyed.join(sized(few, MAX_BROADCAST), F.col(i).eqNullSafe(F.col("_a")) & (F.col(h) == F.col("_b")), how)

    gone, repeated = judged.where("not stays"), judged.where("stays and n > 1")
    if not repeated.take(1):
        return match(gone, "left_anti").select(*names)
    once = match(repeated, "left_semi").dropDuplicates([i, h])
    return match(gone.unionByName(repeated), "left_anti").unionByName(once).select(*names)
