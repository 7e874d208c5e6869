"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated at most ``MAX_REPEATS`` times. A document's virtual
finish time is its source's words up to it divided by the source's target, so at virtual time 1 each source has given
its target; the copy that a source is giving at that moment is cut in two packets there. A global range sort by virtual
finish time interleaves the sources in proportion, running sums give each packet its place in the mix, and the mix ends
where the total budget does: it takes the packets up to there, and of the last one what is left. The default budget is
all words, which the targets share; so it ends about virtual time 1, where packets that finish later fill up what
fractions of words leave.

The running sums are two-pass: rows are range-sorted by (source, shuffle key), each task sums its own run, and offsets
come from one total per task and source. A source that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise, sized, task_ids

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Keys of repeated rows that are broadcast at most.
MAX_BROADCAST = 300_000


def n_words(text):
    """The words of a text: maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, total, slack) of each source; ``sizes``: source, size.

    ``total``: all words, the sum of the targets. ``slack``: how many words the whole words of all targets fall short of
    it at most, one a source.

    Sources by code point, null last, weigh ``weights``, repeating. All words are shared by weight; a target stops at
    ``repeats`` times its source's words and the excess is shared again by weight until none is above. That fixed point
    is found at once: with the sources by rising cap per weight, those before the first that isn't capped are capped.
    The windows run over one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = total.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * repeats).withColumn("r", F.col("cap").cast("double") / F.col("w"))
    every = Window.partitionBy()
    before = Window.orderBy("r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        # the level that the sources from this one on would share, if all before it are capped
        .withColumn("level", F.col("rest").cast("double") / F.col("left"))
        .withColumn("open", F.col("r") >= F.col("level"))
        .withColumn("shared", F.min(F.when(F.col("open"), F.struct("r", F.col("source").isNull(), "source", "level"))).over(every)["level"])
    )
    capped = F.col("shared").isNull() | (F.col("r") < F.col("shared"))
    return rows.select(
        "source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("w") * F.col("shared")).alias("target"),
        F.sum("source_size").over(every).alias("total"), (F.count(F.lit(1)).over(every) + 1).alias("slack"))


def running(rows: DataFrame, key: list[str], group: str, size: str, name: str, into: str = "before") -> DataFrame:
    """``rows`` with ``into``: the sum of ``size`` of the rows of the same group that come earlier by ``key``.

    ``rows`` must be range-sortable by (group, key); ``size`` is a long.
    """
    laid = rows.repartitionByRange(F.col(group).asc_nulls_last(), *key).sortWithinPartitions(F.col(group).asc_nulls_last(), *key)
    fields = [f for f in laid.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, _ = task_ids()
        held, at = object(), 0
        for b in batches:
            before = []
            for g, n in zip(b.column(group).to_pylist(), b.column(size).to_pylist(), strict=True):
                if g != held:
                    held, at = g, 0
                before.append(at)
                at += n
            cols = [*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "_part", "_before"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    done = materialise(laid.mapInArrow(run, f"{schema}, _part int, _before long"), name)
    # one row per task and group: a task holds a run of groups, so there are at most (tasks + groups) of them
    ends = done.groupBy(group, "_part").agg(F.max(F.col("_before") + F.col(size)).alias("_sum"))
    order = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = ends.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_offset"))
    joined = done.join(offset, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.select(*[F.col(f.name) for f in fields], (F.col("_before") + F.col("_offset")).alias(into))


def shuffle_key(doc_id):
    """Orders the documents of a source: a digest of the id, the same in every engine and at every partitioning."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def queues(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, hashed: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, total, slack, before of every row of ``docs`` (doc_id, source, text).

    ``before``: its source's words that come earlier. Rows with equal ids are ordered by their size. A null source is a
    source of its own. With ``hashed``, a column hash of the text comes along.
    """
    extra = [F.xxhash64("text").alias("hash")] if hashed else []
    sizes = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), *extra,
    ).withColumn("shuffle", shuffle_key(F.col("doc_id"))), "sizes")
    goal = materialise(targets(sizes, weights, repeats).withColumnRenamed("source", "_source"), "targets")
    queued = running(sizes, ["shuffle", "doc_id", "size"], "source", "size", "queues")
    # one row per source, a bounded side in any sane corpus, but not proven so: the join is left to the planner
    rows = queued.join(goal, F.col("source").eqNullSafe(F.col("_source")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "total", "slack", "before", *(["hash"] if hashed else []))


def queued_up(queued: DataFrame):
    """Whether a document can be reached: virtual time 1, and as many words as the budget has beyond it, find it begun."""
    return (F.col("size") > 0) & (F.col("before") < F.floor("target") + F.col("slack"))


def schedule(queued: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """A row per packet (``copy`` from 0, ``start``, ``words``, ``finish``) of the copies that can be reached.

    A copy is one packet, or two where its source's target falls inside it, cut at the whole words of the target.
    ``start`` is the words that its source gives before a packet, and ``finish``, its virtual finish time, those up to
    its end divided by the target.
    """
    copies = queued.where(queued_up(queued)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    begin, cut = F.col("before") + F.col("copy") * F.col("source_size"), F.floor("target")
    end = begin + F.col("size")
    packet = lambda a, z: F.struct(a.alias("start"), (z - a).alias("words"))
    two = F.explode(F.array(packet(begin, F.least(end, F.greatest(begin, cut))), packet(F.least(end, F.greatest(begin, cut)), end)))
    packets = copies.where(begin < cut + F.col("slack")).select("*", two.alias("p")).where("p.words > 0")
    return packets.select(*copies.columns, "p.start", "p.words").withColumn("finish", (F.col("start") + F.col("words")) / F.col("target"))


def in_order(scheduled: DataFrame, budget: int | None = None) -> DataFrame:
    """The scheduled packets with ``offset``, the words of the mix before one, truncated where the mix has ``budget`` words.

    Packets are globally range-sorted by virtual finish time (ties by id, source, copy and start), with two-pass running
    sums. The budget is the words of all sources, or ``budget`` if that is less. ``words`` becomes what it leaves of a
    packet; those beyond it keep zero words.
    """
    laid = running(scheduled.withColumn("_all", F.lit(0)), ["finish", "doc_id", "source", "copy", "start"], "_all", "words", "mix", "offset").drop("_all")
    most = F.col("total") if budget is None else F.least(F.col("total"), F.lit(budget).cast("long"))
    return laid.withColumn("words", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), most - F.col("offset"))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_offset of every row of ``docs`` (doc_id, source, text).

    ``taken``: the words that the mix takes of it, over all repeats; ``first_offset``: the words of the mix before its
    first packet, null where none is taken. Without a smaller ``budget`` the mix has as many words as the documents, and
    each source gives the whole words of its target and what fractions leave. Null and empty texts have no words and
    give none. Equal rows share alike only in sum. An empty table gives no row; other columns aren't read.
    """
    queued = queues(docs, weights, repeats)
    # documents with words differ in (source, before), so the group of a row's packets is the row itself
    row = ["doc_id", "source", "size", "source_size", "target", "before"]
    given = in_order(schedule(queued, repeats), budget).groupBy(*row).agg(
        F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("offset"))).alias("first_offset"))
    rest = queued.where(~queued_up(queued)).select(*row, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_offset"))
    return given.unionByName(rest).select(*row[:-1], "taken", "first_offset")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix as documents: rows of ``docs``, with all columns, as often as they are taken, in order of virtual time.

    Texts stay whole: a copy that the mix's end or its source's target cuts is kept where the mix takes half of it or
    more. A row is known by its id, source and a hash of its text; rows equal in these are taken as copies of one. Null
    and empty texts have no words and are never taken. An empty table gives none. Columns may have any names.

    The plan, a row per document, is broadcast to the texts up to ``MAX_BROADCAST`` rows, so that they are shuffled once,
    by the sort; beyond it the join shuffles them too.
    """
    names = docs.columns
    i, c, h = (fresh(names, n) for n in ("_id", "_source", "_hash"))
    key = {i: F.col("doc_id").cast("long"), c: F.col("source").cast("string"), h: F.xxhash64("text")}
    packets = in_order(schedule(queues(docs, weights, repeats, hashed=True), repeats))
    plan = packets.groupBy("doc_id", "source", "hash", "before", "size", "copy").agg(F.sum("words").alias("words"), F.max("finish").alias("finish")).where("2 * words >= size")
    plan = materialise(plan.groupBy("doc_id", "source", "hash").agg(F.array_sort(F.collect_list(F.struct("copy", "finish", "before"))).alias("p")), "schedule")
    keyed = docs.withColumns(key)
    twice = materialise(keyed.groupBy(i, c, h).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(i, c, h), "repeated")
    if twice.take(1):
        on = lambda a, b: F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))
        same = on(i, i) & on(c, c) & on(h, h)
        few = sized(twice, MAX_BROADCAST).alias("b")
        once = keyed.alias("a").join(few, same, "left_semi").dropDuplicates([i, c, h])
        keyed = keyed.alias("a").join(few, same, "left_anti").unionByName(once)
    rows = keyed.alias("a").join(
        sized(plan, MAX_BROADCAST).alias("p"), F.col(f"a.{i}").eqNullSafe(F.col("p.doc_id")) & F.col(f"a.{c}").eqNullSafe(F.col("p.source")) & (F.col(f"a.{h}") == F.col("p.hash")))
    laid = rows.select(*[F.col(f"a.`{n}`") for n in names], F.explode("p.p").alias(x := fresh(names, "_copy")))
    order = [F.col(f"`{x}`.finish"), F.col("doc_id"), F.col(f"`{x}`.copy"), F.col(f"`{x}`.before")]
    return laid.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{n}`") for n in names])
