"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents.  A document's virtual finish
time is the number of its source's words up to its end, repeats of the source
included, divided by the source's target.  All queues together are sorted by
that time into ranges, and the order is cut where the total budget is spent.

Scale: texts are read once, for their number of words; what is sorted are rows
of ids and numbers.  Cumulative sums within a source are taken in two steps,
sums of hash buckets first and then rows within a bucket, so that a source
holding most rows is spread over all tasks.  For the global cut the sums of the
sorted ranges tell the range that holds it; only in that one rows are counted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, clean_name, cut, n_words, unique_ids

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_PER_BUCKET = 256


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size) with each source's weight and target.

    Sources in code point order, null last, get the weights in turn.  They
    share the sum of all sizes by weight; no target passes ``epochs`` times the
    source's size, and what is above is shared again by weight among the rest.
    In the order of size over weight the limited sources come first, so one
    ordered pass over the sources finds the level of the others.
    """
    lcm = math.lcm(*weights)
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    order = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), order).cast("long"))
    out = out.withColumn("cap", epochs * F.col("source_size")).withColumn("fill", F.col("source_size") * (F.lit(lcm) / F.col("weight")).cast("long"))
    out = out.withColumn("place", F.row_number().over(by_fill))
    ahead = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = out.withColumn("total", F.sum("source_size").over(every)).withColumn("full", F.coalesce(F.sum("cap").over(ahead), F.lit(0)))
    out = out.withColumn("open_weight", F.sum("weight").over(rest))
    level = F.when((F.col("total") - F.col("full")).cast("double") * F.col("weight") <= F.col("cap").cast("double") * F.col("open_weight"), F.struct("place", "full", "open_weight"))
    out = out.withColumn("level", F.min(level).over(every))
    shared = (F.col("total") - F.col("level.full")).cast("double") * F.col("weight") / F.col("level.open_weight")
    target = F.when(F.col("place") < F.col("level.place"), F.col("cap").cast("double")).otherwise(F.least(shared, F.col("cap").cast("double")))
    return out.withColumn("target", F.coalesce(target, F.col("cap").cast("double"))).select("source", "source_size", "weight", "target", "total")


def schedule(docs: DataFrame, *, key: list[str] = ("doc_id",), divide: bool = True, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, seed: str = "") -> DataFrame:
    """What the mix takes of each document, an entry per document, epoch and piece.

    ``docs`` has doc_id, source, text and the columns of ``key``, which are
    carried along.  Every document stands ``epochs`` times in its source's queue.
    With ``divide`` the one that is in progress when its source's target is met
    is two pieces, up to that word and from it on, else all are whole.  ``take``
    is the number of words taken: all of the entries before the cut, none
    behind it, and of the entry at the cut what is left of the budget, without
    ``divide`` all of it or, if less than half fits, nothing.

    An entry that takes nothing is returned only for the first piece of epoch
    0, so each row of ``docs`` has one at least.  Null texts have size 0.  A
    null source is a source of its own.  Repeated rows are documents of their
    own; which of two rows of equal doc_id and size comes first makes no
    difference.  Empty input gives empty output; columns of other names are not
    looked at.
    """
    with Scratch(docs.sparkSession) as scratch:
        order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        queue = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
        base = scratch.cut(docs.select(*key, F.col("source").alias("source"), queue.alias("queue"), n_words(F.col("text")).alias("size"), order.alias("shuffle")))
        rows = base.count()
        digits = min(8, max(1, math.ceil(math.log(max(rows, 1) / ROWS_PER_BUCKET, 16)) if rows > ROWS_PER_BUCKET else 1))
        base = base.withColumn("bucket", F.substring("shuffle", 1, digits))
        sums = base.groupBy("queue", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
        sums = scratch.cut(sums)
        targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, epochs)
        targets = targets.withColumn("queue", queue).drop("source")
        ahead = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        plan = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).drop("source", "bucket_size").join(targets, "queue")
        inside = Window.partitionBy("queue", "bucket").orderBy("shuffle", "size")
        queued = base.join(plan, ["queue", "bucket"]).withColumn("nth", F.row_number().over(inside))
        queued = queued.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        entries = scratch.cut(queued.drop("start", "shuffle")).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        return _truncated(_pieces(entries, divide), divide, scratch)


def _pieces(entries: DataFrame, divide: bool) -> DataFrame:
    """Entries, those in progress at their source's target divided there, with their ``words`` and virtual finish."""
    begin = F.col("epoch") * F.col("source_size") + F.col("before")
    entries = entries.withColumn("begin", begin.cast("long")).drop("before")
    end, met = F.col("begin") + F.col("size"), F.floor("target").cast("long")
    part = lambda nth, a, b: F.struct(F.lit(nth).alias("piece"), (b - a).alias("words"), b.alias("end"))
    whole = F.array(part(0, F.col("begin"), end))
    if divide:
        whole = F.when((F.col("begin") < met) & (met < end), F.array(part(0, F.col("begin"), met), part(1, met, end))).otherwise(whole)
    entries = entries.withColumn("p", F.explode(whole)).select("*", "p.*").drop("p", "begin")
    finish = F.col("end").cast("double") / F.nullif(F.col("target"), F.lit(0.0))
    return entries.withColumn("virtual_finish", F.coalesce(finish, F.lit(0.0))).drop("end")


def _truncated(entries: DataFrame, divide: bool, scratch: Scratch) -> DataFrame:
    """Entries in global order of virtual finish, cut at the total budget."""
    order = ["virtual_finish", "queue", "bucket", "nth", "epoch", "piece"]
    ranged = scratch.cut(entries.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    budget, spent, at = ranged.agg(F.max("total")).first()[0] or 0, 0, -1
    for r in ranged.groupBy("range").agg(F.sum("words").alias("words")).orderBy("range").collect():  # a row per sorted range, a number for each task
        at = r["range"]
        if spent + r["words"] > budget:
            break
        spent += r["words"]
    else:
        at += 1
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget - spent) - F.col("ahead")))
    if not divide:
        left = F.when(2 * left >= F.col("words"), F.col("words")).otherwise(F.lit(0))
    cut_range = ranged.where(F.col("range") == at).withColumn("ahead", ahead).withColumn("take", left.cast("long")).drop("ahead")
    others = ranged.where(F.col("range") != at).withColumn("take", F.when(F.col("range") < at, F.col("words")).otherwise(F.lit(0).cast("long")))
    out = others.unionByName(cut_range).where((F.col("take") > 0) | (F.col("epoch") == 0) & (F.col("piece") == 0))
    return cut(out.drop("range"))


def taken_by_document(entries: DataFrame) -> DataFrame:
    """A row per document: the words that the mix takes of it over all epochs."""
    one = ["doc_id", "source", "size", "source_size", "target", "bucket", "nth"]
    return entries.groupBy(*one).agg(F.sum("take").alias("taken"), F.count(F.when(F.col("take") > 0, 1)).alias("times")).drop("bucket", "nth")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole documents.

    A source that gets less than its size loses documents; one that gets more
    repeats some.  Columns are those of ``docs``, whatever their names.  Rows
    that are equal in all columns count as documents of their own, rows without
    words are never taken.  Where doc_id does not tell rows apart, a written
    copy of ``docs`` is numbered.
    """
    mark = "doc_id"
    if not unique_ids(docs):
        mark = clean_name(docs, "mix_row")
        docs = cut(docs.withColumn(mark, F.monotonically_increasing_id()))
    times, own = clean_name(docs, "mix_times"), [c for c in docs.columns if c != mark or c == "doc_id"]
    key = list(dict.fromkeys(["doc_id", mark]))
    entries = schedule(docs.select(*key, "source", "text"), key=key, divide=False, weights=weights, epochs=epochs)
    taken = cut(entries.where("take > 0").groupBy(mark).agg(F.count("*").cast("int").alias(times)))
    found = docs.join(taken, mark)
    return found.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in own])
