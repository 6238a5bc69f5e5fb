"""Transactions of a log put together again, from summaries of ranges of the log.

The log is cut into chunks of consecutive records. Within a chunk, windows over each source resolve what they can: a
rollback undoes the changes since the latest savepoint that is open, found as the next rollback at the same depth. What a
chunk leaves over for a source is a summary: the rollbacks that found no savepoint or change of theirs, the savepoints left open, the number of
pending changes, and the first end of a transaction. Summaries are associative: a scan forward tells how deep each chunk
begins, one backward which rollbacks and which end meet its pending changes. So no task holds more than a chunk or 64
summaries, nothing is broadcast, also where one source has most of the log; a summary keeps no more rollbacks than savepoints are open before it, and one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.scan import BITS, levels, offsets, running, scan

#: Records of a chunk (a power of two), as bits; bits of a record's place in its part of the log, as Spark numbers rows.
CHUNK_BITS, PART_BITS = 10, 33
#: Commits of an epoch, and epochs of a block.
EVERY, BLOCK_BITS = 4, 9
END = ("commit", "abort")


def _numbered(log: DataFrame) -> tuple[DataFrame, list[int]]:
    """The log with its order (pos) and chunk, held in the shared folder; the shifts by which chunks are grouped."""
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "source", "op", "key", "value"]  # rows alike in all are interchangeable
    own = log.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    own = cut(own.withColumn("chunk", F.shiftright("pos", CHUNK_BITS)))
    place, part = own.agg(F.max(F.col("pos").bitwiseAND((1 << PART_BITS) - 1)), F.max(F.shiftright("pos", PART_BITS))).first()
    inner, shifts = PART_BITS - CHUNK_BITS, []
    while (place or 0) >> CHUNK_BITS + sum(shifts) + BITS and sum(shifts) + BITS < inner:
        shifts.append(BITS)
    shifts.append(inner - sum(shifts))
    return own, [*shifts, *levels(part or 0)]


def _local(own: DataFrame, shifts: list[int], every: int) -> DataFrame:
    """What each chunk resolves by itself.

    txn: ends of transactions of the source before it in the chunk; level: open savepoints after it that its chunk opened;
    open: those at the end of that txn in the chunk; by: the rollback that undoes a change; end: how its txn ends here.
    """
    commits = offsets(own.groupBy(F.col("chunk").alias("node")).agg(F.count(F.when(F.col("op") == "commit", 1)).alias("s")), shifts)
    rows = own.join(commits.select(F.col("node").alias("chunk"), F.col("state").alias("earlier")).hint("merge"), "chunk")
    by = lambda *cols: Window.partitionBy("chunk", *cols).orderBy("pos")
    before = (Window.unboundedPreceding, -1)
    number = F.col("earlier") + F.count(F.when(F.col("op") == "commit", 1)).over(by())
    rows = rows.withColumn("epoch", F.when(F.col("op") == "commit", F.floor((number - 1) / every) + 1).cast("long"))
    rows = rows.withColumn("ends", F.col("op").isin(*END))
    rows = rows.withColumn("txn", F.coalesce(F.sum(F.col("ends").cast("int")).over(by("source").rowsBetween(*before)), F.lit(0)))
    txn = by("source", "txn")
    whole = txn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("sum", F.sum(F.when(F.col("op") == "savepoint", 1).when(F.col("op") == "rollback", -1).otherwise(0)).over(txn))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("sum").over(txn)))
    rows = rows.withColumn("level", (F.col("sum") - F.col("low")).cast("int"))
    rows = rows.withColumn("unmatched", (F.col("op") == "rollback") & (F.col("sum") < F.coalesce(F.lag("low").over(txn), F.lit(0))))
    rows = rows.withColumn("open", F.last("level").over(whole))
    rows = rows.withColumn("end", F.max(F.when(F.col("ends"), F.struct("pos", "op", "doc_id", "epoch"))).over(whole))
    # A rollback stands at the depth that it undoes.
    rows = rows.withColumn("at", F.col("level") + F.when((F.col("op") == "rollback") & ~F.col("unmatched"), 1).otherwise(0))
    later = Window.partitionBy("chunk", "source", "txn", "at").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("by", F.when(F.col("op") == "change", F.last(F.when(F.col("op") == "rollback", F.struct("doc_id")), ignorenulls=True).over(later)))
    return cut(rows.select("chunk", "source", "pos", "doc_id", "op", "key", "value", "epoch", "txn", "level", "open", "unmatched", "ends", "end", "by"))


def _summaries(rows: DataFrame) -> DataFrame:
    """(source, node, s): what each chunk leaves over for a source.

    k: rollbacks that found nothing of theirs before the first end; u: these, in order; j: savepoints open at the end.
    """
    stray = F.col("unmatched") & (F.col("txn") == 0)
    return rows.groupBy("source", F.col("chunk").alias("node")).agg(
        F.struct(
            F.max("ends").alias("ended"),
            F.count(F.when(stray, 1)).cast("int").alias("k"),
            F.max_by(F.when(F.col("ends"), 0).otherwise(F.col("level")), "pos").alias("j"),
            F.count(F.when((F.col("op") == "change") & F.col("by").isNull() & F.col("end").isNull(), 1)).alias("pending"),
            F.transform(F.array_sort(F.collect_list(F.when(stray, F.struct("pos", "doc_id")))), lambda r: r["doc_id"]).alias("u"),
            F.min(F.when(F.col("ends"), F.struct("pos", "op", "doc_id", "epoch"))).alias("end"),
        ).alias("s")
    )


def _then(a: Column, b: Column) -> list[Column]:
    """ended, k, j of one stretch of the log and then another."""
    zero = F.lit(0)
    return [
        (a["ended"] | b["ended"]).alias("ended"),
        (a["k"] + F.when(a["ended"], zero).otherwise(F.greatest(b["k"] - a["j"], zero))).alias("k"),
        (b["j"] + F.when(b["ended"], zero).otherwise(F.greatest(a["j"] - b["k"], zero))).alias("j"),
    ]


def _depths(summaries: DataFrame, shifts: list[int]) -> DataFrame:
    """(source, node, state: int): savepoints open where each chunk begins, by a scan forward."""
    leaves = summaries.select("source", "node", F.struct("s.ended", "s.k", "s.j").alias("s"))
    up = lambda kids: F.aggregate(F.slice(kids, F.lit(2), F.size(kids)), F.get(kids, F.lit(0))["s"], lambda a, k: F.struct(*_then(a, k["s"])))
    after = lambda d, s: s["j"] + F.when(s["ended"], F.lit(0)).otherwise(F.greatest(d - s["k"], F.lit(0)))
    return scan(leaves, ["source"], shifts, up, running(after), F.lit(0))


def _fates(summaries: DataFrame, shifts: list[int]) -> DataFrame:
    """(source, node, state: struct(u, end)): the rollbacks and the end that meet what each chunk leaves pending, by a scan backward."""
    depth = _depths(summaries, shifts).withColumnRenamed("state", "d")
    needed = lambda u, d: F.slice(u, F.lit(1), d + 1)  # noqa: E731  no more can undo anything before
    s = lambda *head, u, end, d: F.struct(*head, needed(u, d).alias("u"), end.alias("end"), d.alias("d"))
    leaves = summaries.join(depth.hint("merge"), ["source", "node"]).select("source", F.col("node"), s(F.col("s.ended"), F.col("s.k"), F.col("s.j"), u=F.col("s.u"), end=F.col("s.end"), d=F.col("d")).alias("s"))
    met = lambda a, b: F.when(a["ended"], a["u"]).otherwise(F.concat(a["u"], F.slice(b["u"], a["j"] + 1, F.size(b["u"]))))
    ended = lambda a, b: F.when(a["ended"], a["end"]).otherwise(b["end"])
    back = lambda kids: F.reverse(kids)

    def up(kids: Column) -> Column:
        return F.aggregate(F.slice(back(kids), F.lit(2), F.size(kids)), F.get(back(kids), F.lit(0))["s"], lambda b, k: s(*_then(k["s"], b), u=met(k["s"], b), end=ended(k["s"], b), d=k["s"]["d"]))

    first = leaves.select(F.struct(F.slice("s.u", 1, 0).alias("u"), F.when(F.lit(False), F.col("s.end")).alias("end")).alias("f")).schema["f"].dataType
    nothing = F.from_json(F.lit('{"u": []}'), first.simpleString())
    down = lambda kids, state: running(lambda b, a: F.struct(met(a, b).alias("u"), ended(a, b).alias("end")))(back(kids), state)
    return scan(leaves, ["source"], shifts, up, down, nothing)


def resolve(log: DataFrame, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """(changes, commits) of a log (doc_id: long, source: string, op, key, value), whose op is commit, abort, savepoint, rollback or change.

    changes: (doc_id, key, value, outcome, by, epoch, order): outcome is commit, rollback or abort, by the record that
    decides it (null where the log ends), and for a commit its epoch and the order of application. commits: (epoch) of each.
    The log goes by doc_id; records of one doc_id by their other columns; rows alike in all count each, in some order. A
    null source is a source. Records without doc_id or op have no place in the log and are left out; an empty log gives empty results.
    """
    named = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))
    own, shifts = _numbered(log.where("doc_id is not null and op is not null").select(F.col("doc_id").cast("long").alias("doc_id"), named.alias("source"), "op", "key", "value"))
    rows = _local(own, shifts, every)
    summaries = cut(_summaries(rows))
    fates = _fates(summaries, shifts)
    waiting = summaries.where("s.pending > 0").select("source", "node").join(fates.hint("merge"), ["source", "node"]).select("source", F.col("node").alias("chunk"), "state")
    changes = rows.where("op = 'change'")
    here = changes.where("by is not null or end is not null").withColumn("later", F.lit(None).cast(waiting.schema["state"].dataType))
    rest = changes.where("by is null and end is null").join(waiting.withColumnRenamed("state", "later").hint("merge"), ["source", "chunk"])
    undone = F.coalesce("by", F.get(F.transform("later.u", lambda x: F.struct(x.alias("doc_id"))), F.col("open") - F.col("level")))
    both = here.unionByName(rest.select(*here.columns)).withColumn("undone", undone).withColumn("end", F.coalesce("end", "later.end"))
    outcome = F.when(F.col("undone").isNotNull(), "rollback").otherwise(F.coalesce("end.op", F.lit("abort")))
    done = both.withColumn("outcome", outcome).withColumn("applied", F.col("outcome") == "commit")
    changes = done.select("doc_id", "key", "value", "outcome", F.when(F.col("undone").isNotNull(), F.col("undone.doc_id")).otherwise(F.col("end.doc_id")).alias("by"), F.when(F.col("applied"), F.col("end.epoch")).alias("epoch"), F.when(F.col("applied"), F.struct("end.pos", F.col("pos").alias("change"))).alias("order"))
    return cut(changes), rows.where("op = 'commit'").select("epoch")


def states(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """(epoch, n, value): after each epoch, the stored keys and the sum of their values (long; a null value deletes its key).

    Of an epoch only the last change of a key counts; each counts for the difference to the one before of its key. Keys and epochs
    are scanned in blocks of epochs, so neither has a task of its own.
    """
    block = F.shiftright("epoch", BLOCK_BITS)
    last = cut(changes.where("outcome = 'commit'").groupBy("epoch", "key").agg(F.max_by("value", "order").alias("value")).withColumn("block", block))
    shifts = levels((commits.agg(F.max("epoch")).first()[0] or 0) >> BLOCK_BITS)
    own = last.withColumn("key", F.coalesce(F.col("key").cast("string"), F.lit("")))  # keys of the scan are not null
    leaves = own.groupBy("key", F.col("block").alias("node")).agg(F.max_by(F.struct("value"), "epoch").alias("s"))
    none = F.from_json(F.lit("{}"), leaves.schema["s"].dataType.simpleString())
    came = scan(leaves, ["key"], shifts, lambda kids: F.element_at(kids, -1)["s"], running(lambda _, s: s), none).select("key", F.col("node").alias("block"), F.col("state.value").alias("came"))
    order = Window.partitionBy("key", "block").orderBy("epoch")
    steps = own.join(came.hint("merge"), ["key", "block"]).withColumn("was", F.when(F.row_number().over(order) == 1, F.col("came")).otherwise(F.lag("value").over(order)))
    there = lambda c: F.col(c).isNotNull().cast("long")
    delta = steps.select("epoch", (there("value") - there("was")).alias("n"), (F.coalesce("value", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("value"))
    zero = F.lit(0).cast("long")
    each = cut(delta.unionByName(commits.select("epoch", zero.alias("n"), zero.alias("value"))).groupBy("epoch").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).withColumn("block", block))
    added = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["value"] + b["value"]).alias("value"))
    nothing = F.struct(zero.alias("n"), zero.alias("value"))
    sums = each.groupBy(F.col("block").alias("node")).agg(F.struct(F.sum("n").alias("n"), F.sum("value").alias("value")).alias("s"))
    came = scan(sums, [], shifts, lambda kids: F.aggregate(kids, nothing, lambda a, k: added(a, k["s"])), running(added), nothing)
    so_far = Window.partitionBy("block").orderBy("epoch")
    return each.join(came.select(F.col("node").alias("block"), "state").hint("merge"), "block").select("epoch", (F.col("state.n") + F.sum("n").over(so_far)).alias("n"), (F.col("state.value") + F.sum("value").over(so_far)).alias("value"))


def records(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents as a log: what a record does follows from the CRC of its doc_id; the value of a change is the CRC of `key:text`,
    null (a deletion) if the text is null or the document is labelled toxic."""
    toxic = labels.where("toxic = 1 and doc_id is not null").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    own = documents.select("doc_id", "source", "text").where("doc_id is not null").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    kind = F.col("h") % 23
    op = F.when(kind <= 1, "commit").when(kind == 2, "abort").when(kind <= 4, "savepoint").when(kind <= 6, "rollback").otherwise("change")
    key = F.floor(F.col("h") / 100) % 300
    value = F.crc32(F.concat(key.cast("string"), F.lit(":"), "text").cast("binary"))
    own = own.select("doc_id", "source", op.alias("op"), key.alias("key"), value.alias("value")).join(toxic.hint("merge"), "doc_id", "left")
    return own.withColumn("value", F.when(F.col("toxic").isNull(), F.col("value"))).drop("toxic")


def reassembled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, id, n, value): a row `state` for each epoch, and a row `rollback` or `abort` for each change that was undone."""
    changes, commits = resolve(records(documents, labels))
    after = states(changes, commits).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", "value")
    undone = changes.where("outcome <> 'commit'").select(F.col("outcome").alias("kind"), F.col("doc_id").alias("id"), F.col("by").alias("n"), F.col("key").cast("long").alias("value"))
    return after.unionByName(undone)
