"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's sketch is the k smallest hashes of its word shingles.  Inverted
lists of the retained values generate candidate pairs, an estimate on the
sketch of the union filters them, and the exact Jaccard similarity of the full
shingle sets confirms a link.

Documents of equal shingle sets are one class, and only class representatives
take part.  A list never yields all its pairs: lists of two or three members
give theirs, longer ones give a star per round, from each member to a pivot.
When a round has merged what it can, only pairs across components are of
interest; those that share long lists alone are found in the last step, an
exact prefix-filter join of the full sets of the documents that can have them.

A link is lost only if a pair above the threshold shares fewer than the
``least_shared`` values of the k smallest of its union: for k = 64 and
similarity 0.85 at 29 values the chance is below 1e-11.  Documents of up to k
shingles are held whole.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, bloom, clean_name, cut, list_array, may_hold, ngram_hashes, slices, texts_of, unique_ids, without
from .components import components

SHINGLE = 3
PERCENT = 85
K = 64
BLOCK = 1024
WHOLE = 256
HELD_LISTS = 64
STAR_SHARE = 8


def least_shared(k: int, percent: int) -> int:
    """Values of the union's k smallest that a linked pair shares at least, but for a chance of about 1e-11."""
    t = percent / 100
    for m in range(int(k * t), 0, -1):
        x = m / k
        if k * (x * math.log(x / t) + (1 - x) * math.log((1 - x) / (1 - t))) >= 25:
            return m
    return 1


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values): each text's different shingles as sorted hashes.

    A text of fewer than ``n`` words has its whole sequence as one shingle, a
    text without words none.
    """
    h, counts, offsets = words.hashes(), words.counts, words.offsets
    owner = words.owner()
    grams = ngram_hashes(h, n, seed=n)
    inside = np.flatnonzero(owner[: len(grams)] == owner[n - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
    values, of = grams[inside], owner[inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = [ngram_hashes(h[offsets[i] : offsets[i + 1]], int(counts[i]), seed=int(counts[i]))[0] for i in short]
        values, of = np.concatenate([values, np.array(own, dtype=np.uint64)]), np.concatenate([of, short])
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[first], of[first]
    return np.searchsorted(of, np.arange(len(words) + 1)), values


def _sketches(batches, n: int, k: int):
    for batch in batches:
        for part in slices(batch, "text"):
            at, values = shingle_sets(Words(texts_of(part), lower=True), n)
            size = np.diff(at)
            digest = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(at, at[1:])]
            held = np.minimum(size, k)
            bounds = np.concatenate([[0], np.cumsum(held)])
            pick = np.arange(bounds[-1]) + np.repeat(at[:-1] - bounds[:-1], held)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), list_array(values[pick].view(np.int64), bounds, pa.int64())], names=["doc_id", "row_id", "n_shingles", "digest", "sketch"])


def _full_sets(batches, n: int, wanted):
    for batch in batches:
        batch = batch.filter(pa.array(may_hold(wanted.value, batch.column("row_id").to_numpy(zero_copy_only=False))))
        for part in slices(batch, "text"):
            at, values = shingle_sets(Words(texts_of(part), lower=True), n)
            yield pa.RecordBatch.from_arrays([part.column("row_id"), list_array(values.view(np.int64), at, pa.int64())], names=["row_id", "shingles"])


def _holding(batches, wanted):
    for batch in batches:
        yield batch.filter(pa.array(may_hold(wanted.value, batch.column("row_id").to_numpy(zero_copy_only=False))))


def holding(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` without most of the rows that ``rows`` (row_id) does not name, so that a join moves few."""
    wanted = df.sparkSession.sparkContext.broadcast(bloom(rows))
    return df.mapInArrow(partial(_holding, wanted=wanted), df.schema)


def full_sets(docs: DataFrame, rows: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(row_id, shingles) of the documents ``rows`` (row_id, written), each once.

    A filter of the rows is broadcast, so texts stay where they are; only sets
    are shuffled, those of the few that pass by chance as well.
    """
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bloom(rows))
    sets = docs.select("row_id", "text").mapInArrow(partial(_full_sets, n=n, wanted=wanted), "row_id long, shingles array<long>")
    out = scratch.cut(sets.join(rows, "row_id", "left_semi"))
    wanted.destroy()
    return out


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of lists, wherever its buffers begin."""
    own = column.combine_chunks()
    held = pc.list_value_length(own).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(held)]).astype(np.int64), own.flatten().to_numpy(zero_copy_only=False)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)


def union_shares(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """Of the k smallest values of the union of two sketches (sorted), those that both hold."""
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return int(np.searchsorted(both, union[-1], side="right")) if len(union) else 0


def _passes(a: np.ndarray, b: np.ndarray, k: int, percent: int, floor: int) -> bool:
    if len(a) < k and len(b) < k:  # the sketches are the sets
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * shared >= percent * (len(a) + len(b) - shared)
    shared = union_shares(a, b, k)
    return shared >= min(floor, math.ceil(percent * min(k, len(a) + len(b) - shared) / 100))


def _estimate(batches, k: int, percent: int, floor: int):
    for batch in batches:
        (oa, va), (ob, vb) = _matrix(batch.column("sketch_a")), _matrix(batch.column("sketch_b"))
        keep = [_passes(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]], k, percent, floor) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirm(batches, percent: int):
    for batch in batches:
        (oa, va), (ob, vb) = _matrix(batch.column("set_a")), _matrix(batch.column("set_b"))
        keep = []
        for i in range(batch.num_rows):
            a, b = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
            shared = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class _Linker:
    """The steps that turn candidate pairs into confirmed links, written in ``out``."""

    def __init__(self, docs: DataFrame, sketches: DataFrame, n: int, percent: int, k: int, out: Scratch):
        self.docs, self.sketches, self.n, self.percent, self.k, self.out = docs, sketches, n, percent, k, out
        self.floor = least_shared(k, percent)

    def estimated(self, pairs: DataFrame, scratch: Scratch) -> DataFrame:
        """``pairs`` (a, b), each once, that the sketches of the union let pass."""
        size = lambda x: self.sketches.select(F.col("row_id").alias(x), F.col("n_shingles").alias(f"n_{x}"))
        fit = scratch.cut(pairs.join(size("a"), "a").join(size("b"), "b").where(_sizes_fit("n_a", "n_b", self.percent)).select("a", "b"))
        met = holding(self.sketches, _ends(fit))
        side = lambda x: met.select(F.col("row_id").alias(x), F.col("sketch").alias(f"sketch_{x}"))
        both = fit.join(side("a"), "a").join(side("b"), "b")
        return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(partial(_estimate, k=self.k, percent=self.percent, floor=self.floor), "a long, b long")

    def confirmed(self, pairs: DataFrame, estimate: bool = True) -> DataFrame:
        """Links (a, b) of 'pairs' whose full sets reach the threshold."""
        with Scratch(self.docs.sparkSession) as scratch:
            pairs = scratch.cut(self.estimated(pairs, scratch) if estimate else pairs)
            needed = scratch.cut(_ends(pairs).distinct())
            sets = full_sets(self.docs, needed, self.n, scratch)
            side = lambda x: sets.select(F.col("row_id").alias(x), F.col("shingles").alias(f"set_{x}"))
            both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
            return self.out.cut(both.mapInArrow(partial(_confirm, percent=self.percent), "a long, b long"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("row_id")).union(pairs.select(F.col("b").alias("row_id")))


def _pairs(a, b):
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _short_lists(postings: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs of the lists of two or three members, and the longer lists' values.

    The members of a short list follow from its smallest and largest member and
    their sum, so no list is ever collected.
    """
    lists = scratch.cut(postings.groupBy("value").agg(F.count("*").alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.sum("row_id").alias("sum")).where("n > 1"))
    third = F.col("sum") - F.col("lo") - F.col("hi")
    few = lists.where("n <= 3").select("n", "lo", "hi", third.alias("mid")).distinct()
    two = F.array(_pairs("lo", "hi"))
    three = F.array(_pairs("lo", "hi"), _pairs("lo", "mid"), _pairs("mid", "hi"))
    short = few.select(F.explode(F.when(F.col("n") == 2, two).otherwise(three)).alias("p")).select("p.a", "p.b").distinct()
    return short, lists.where("n > 3").select("value", "n")


def _long_lists(postings: DataFrame, long_values: DataFrame, percent: int, floor: int, scratch: Scratch) -> DataFrame:
    """The postings of long lists of the documents that may be linked by these alone.

    A linked pair that shares no short list has ``need`` values in long ones at
    least, so a document with fewer has none.
    """
    long = scratch.cut(postings.join(long_values, "value"))
    need = F.least(F.lit(floor), F.ceil(F.lit(percent / 100) * F.col("n_shingles")))
    some = long.groupBy("row_id", "n_shingles").agg(F.count("*").alias("own")).where(F.col("own") >= need).select("row_id")
    return scratch.cut(long.join(scratch.cut(some), "row_id", "left_semi"))


def _star(postings: DataFrame, labels: DataFrame | None, salt: int, percent: int, scratch: Scratch) -> DataFrame:
    """A pair from each member of a list to the list's pivot, of another component and a fitting size.

    A round takes one part of the lists in STAR_SHARE; it merges what is easily
    merged, and ``_rest`` finds every link that the rounds leave.
    """
    have = postings.where(F.pmod(F.xxhash64("value"), F.lit(STAR_SHARE)) == salt % STAR_SHARE).select("value", "row_id", "n_shingles")
    if labels is not None:
        have = have.join(labels, have.row_id == labels.node, "left").select("value", "row_id", "n_shingles", F.coalesce("component", "row_id").alias("component"))
        rank = F.xxhash64(F.lit(salt), "value", "row_id")
    else:
        have = have.withColumn("component", F.col("row_id"))
        rank = F.col("row_id")
    top = F.min(F.struct(rank.alias("rank"), F.col("row_id").alias("pivot"), F.col("component").alias("of"), F.col("n_shingles").alias("pivot_n")))
    pivots = have.groupBy("value").agg(top.alias("top"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    # written, so that both sides of the join are plain exchanges and a long list can be split
    pivots = scratch.cut(pivots.where("c0 <> c1").select("value", "top.pivot", "top.of", "top.pivot_n"))
    met = have.join(pivots, "value").where((F.col("component") != F.col("of")) & _sizes_fit("n_shingles", "pivot_n", percent))
    return met.select(_pairs("row_id", "pivot").alias("p")).select("p.a", "p.b").distinct()


def _shared(at: np.ndarray, values: np.ndarray, rows: np.ndarray, columns: np.ndarray, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of the sets ``rows`` with the sets ``columns``.

    Values become columns of 0/1 matrices, ``width`` at a time; their products
    count what two sets share.  Values of one set alone are left out.
    """
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    some = times[code] > 1
    code, owner = (np.cumsum(times > 1) - 1)[code[some]], owner[some]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [low, low + width])
        dense = np.zeros((len(at) - 1, width), dtype=np.float32)
        dense[owner[a:b], code[a:b] - low] = 1
        out += dense[rows] @ dense[columns].T
    return out


def likely_pairs(ids: np.ndarray, component: np.ndarray, size: np.ndarray, side: np.ndarray, one: bool, brief: tuple, earlier: tuple, k: int, percent: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components within a block or across two that may be linked.

    ``brief``, (offsets, values), has short forms of whole sets or, of larger ones, of the ``k``
    smallest, of which a linked pair shares ``floor`` (see ``least_shared``).
    One may be lost where two of a text have the same form, hence the allowance
    of one.  ``earlier`` has the lists before this one that each is in; a pair
    that shares one is met there.
    """
    left = np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    a, b = size[left][:, None], size[right][None, :]
    hit = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    hit &= component[left][:, None] != component[right][None, :]
    if one:
        hit = np.triu(hit)
    if hit.any():
        hit &= _shared(*earlier, left, right) == 0
    if not hit.any():
        return ids[:0], ids[:0]
    held = np.diff(brief[0])
    na, nb = held[left][:, None], held[right][None, :]
    shared = _shared(*brief, left, right) + 1
    union = na + nb - shared
    whole = held == size
    sketched = shared >= np.minimum(floor, np.ceil(percent * np.minimum(k, union) / 100))
    hit &= np.where(whole[left][:, None] & whole[right][None, :], 100 * shared >= percent * union, sketched)
    x, y = (ids[of[at]] for of, at in zip((left, right), np.nonzero(hit)))
    return np.minimum(x, y), np.maximum(x, y)


def _rest(postings: DataFrame, labels: DataFrame, linker: _Linker) -> DataFrame:
    """Links (a, b) across components that share long lists only.

    ``postings`` are those of ``_long_lists``.  The full sets of their documents
    pass the prefix filter: in the order of frequency among these two linked
    sets share one of the first ``size - ceil(percent% of size) + 1`` values.
    In each list the members of its largest component are compared with all
    others, not with each other, and the others among themselves, in blocks of
    about BLOCK members.  Matrix products count what is shared by sets of up to
    WHOLE values, of larger ones by their WHOLE smallest, in short forms of 32
    bits; full sets move for the pairs alone that these let pass.
    """
    docs, n, percent, k = linker.docs, linker.n, linker.percent, WHOLE
    floor = least_shared(k, percent)
    with Scratch(docs.sparkSession) as scratch:
        some = postings.select("row_id").distinct()
        some = scratch.cut(some.join(labels, some.row_id == labels.node, "left").select("row_id", F.coalesce("component", "row_id").alias("component")))
        sets = full_sets(docs, some.select("row_id"), n, scratch)
        every = sets.select("row_id", F.size("shingles").alias("size"), F.explode("shingles").alias("value"))
        often = scratch.cut(every.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"))
        per_row = Window.partitionBy("row_id")
        known = every.join(often, "value").withColumn("known", F.count("*").over(per_row)).withColumn("nth", F.row_number().over(per_row.orderBy("n", "value")))
        prefix = F.col("size") - F.ceil(F.col("size") * percent / F.lit(100)) + 1
        entered = scratch.cut(known.where(F.col("size") - F.col("known") + F.col("nth") <= prefix).select("value", "row_id").join(some, "row_id"))
        shares = entered.groupBy("value", "component").agg(F.count("*").alias("m"), F.sum(F.xxhash64("row_id").cast("decimal(38,0)")).alias("who"))
        lists = shares.groupBy("value").agg(F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("top"), F.sum("who").alias("who"))
        # lists of the same members count once
        lists = lists.where("top.m < all").groupBy("all", "who").agg(F.min(F.struct("value", "top")).alias("first"))
        blocks = lambda x: F.ceil(x / F.lit(BLOCK)).cast("int")
        lists = scratch.cut(lists.select("first.value", F.col("first.top.component").alias("main"), blocks(F.col("first.top.m")).alias("n_main"), blocks(F.col("all") - F.col("first.top.m")).alias("n_other")))
        brief = scratch.cut(sets.select("row_id", F.size("shingles").alias("n_shingles"), F.transform(F.slice("shingles", 1, k), lambda v: F.shiftright(F.shiftleft(v, 32), 32).cast("int")).alias("brief")))
        members = entered.join(lists, "value").withColumn("mine", F.col("component") == F.col("main"))
        # blocks of others are 0 to n_other - 1, those of the largest component come behind
        of = lambda count: F.pmod(F.xxhash64("row_id"), F.col(count)).cast("int")
        members = members.withColumn("block", F.when(F.col("mine"), F.col("n_other") + of("n_main")).otherwise(of("n_other")))
        met = F.when(F.col("mine"), F.col("n_other")).otherwise(F.col("n_other") + F.col("n_main")) - 1
        keyed = members.withColumn("other", F.explode(F.sequence(F.lit(0), met)))
        keyed = keyed.select("value", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"), "row_id", "component")
        # the smallest lists of a document tell in which of several lists a pair is met first
        smallest = scratch.cut(entered.join(lists, "value").groupBy("row_id").agg(F.sort_array(F.collect_list("value")).alias("in_lists")).select("row_id", F.slice("in_lists", 1, HELD_LISTS).alias("in_lists")))
        keyed = keyed.join(brief.join(smallest, "row_id"), "row_id").withColumn("group", F.struct("value", "x", "y"))

        def pairs_of(rows: pa.Table) -> pa.Table:
            ids, component, size, side = (rows.column(c).to_numpy() for c in ("row_id", "component", "n_shingles", "side"))
            at, values = _flat(rows.column("brief"))
            before, lists_ = _flat(rows.column("in_lists"))
            earlier = lists_ < rows.column("value")[0].as_py()
            before = np.concatenate([[0], np.cumsum(earlier)])[before]
            one = rows.column("x")[0].as_py() == rows.column("y")[0].as_py()
            a, b = likely_pairs(ids, component, size, side, one, (at, values), (before, lists_[earlier]), k, percent, floor)
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        return linker.confirmed(keyed.groupBy("group").applyInArrow(pairs_of, "a long, b long").distinct(), estimate=False)


def link(docs: DataFrame, scratch: Scratch, *, n: int = SHINGLE, percent: int = PERCENT, k: int = K, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): sketches with class representative, and components, both in ``scratch``.

    ``rows`` has doc_id, row_id, n_shingles, digest; ``labels`` maps row_id of
    representatives to their component.
    """
    base = docs.select("doc_id", "text")
    schema = "doc_id long, row_id long, n_shingles long, digest binary, sketch array<long>"
    numbered = base.withColumn("row_id", F.col("doc_id"))
    largest = base.agg(F.coalesce(F.max(F.abs(F.col("doc_id").cast("decimal(20,0)"))), F.lit(0))).first()[0]
    if largest >= 1 << 60 or not unique_ids(base):  # ids do not tell rows apart: a written copy numbers them
        numbered = scratch.cut(base.withColumn("row_id", F.monotonically_increasing_id()))
    rows = scratch.cut(numbered.mapInArrow(partial(_sketches, n=n, k=k), schema))
    classes = scratch.cut(rows.where("n_shingles > 0").groupBy("digest").agg(F.min("row_id").alias("rep")))
    with Scratch(docs.sparkSession) as own:
        sketches = own.cut(rows.join(classes.select(F.col("rep").alias("row_id")), "row_id", "left_semi").select("row_id", "n_shingles", "sketch"))
        linker = _Linker(numbered.select("row_id", "text"), sketches, n, percent, k, own)
        postings = sketches.select("row_id", "n_shingles", F.explode("sketch").alias("value"))
        short, long_values = _short_lists(postings, own)
        long = _long_lists(postings, long_values, percent, linker.floor, own)
        lasting = not long.isEmpty()  # else the pairs of short lists are all
        links = linker.confirmed(short.union(_star(long, None, 0, percent, own)).distinct() if lasting else short)
        labels = components(links, own)
        for salt in range(1, rounds + 1 if lasting else 1):
            more = linker.confirmed(_star(long, labels, salt, percent, own))
            if more.isEmpty():
                break
            links = links.union(more)
            labels = components(links, own)
        more = _rest(long, labels, linker) if lasting else None
        if more is not None and not more.isEmpty():
            labels = components(links.union(more), own)
        return rows.join(classes, "digest", "left").select("doc_id", "row_id", "n_shingles", "rep"), scratch.cut(labels)


def near_duplicates(docs: DataFrame, *, n: int = SHINGLE, percent: int = PERCENT, k: int = K, rounds: int = 2) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id, kept, row_id.

    Two documents are linked when their sets of ``n``-word shingles (A-Z in
    lower case) have a Jaccard similarity of ``percent`` or more; a component is
    named by its smallest doc_id.  Null texts and texts without words have the
    empty set and are linked with nothing; a text of fewer than ``n`` words has
    one shingle.  Equal texts are linked, repeated rows too.  Of rows that share
    a component's smallest doc_id one is kept; a component without any doc_id
    keeps one row.  Texts of any length are read whole, an Arrow batch holding
    one at least.  No rows give no rows; columns other than doc_id and text are
    not looked at, whatever their names.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows, labels = link(docs, scratch, n=n, percent=percent, k=k, rounds=rounds)
        out = rows.join(labels, rows.rep == labels.node, "left")
        out = scratch.cut(out.select("doc_id", "row_id", "n_shingles", F.coalesce("component", "rep", "row_id").alias("component")))
        names = out.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first"))
        names = scratch.cut(names.select(F.col("component").alias("of"), F.col("first.doc_id").alias("component_id"), F.col("first.row_id").alias("keep_row")))
        return cut(out.join(names, out.component == names.of).select("doc_id", "n_shingles", "component_id", (F.col("row_id") == F.col("keep_row")).alias("kept"), "row_id"))


def dedup(docs: DataFrame, *, n: int = SHINGLE, percent: int = PERCENT, k: int = K) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns whatever their names.

    The row of a component's smallest doc_id stays (null last).  Where doc_id
    does not tell rows apart, ``docs`` is numbered in a written copy, so that
    rows that are alike in all columns count one by one.  Texts without words
    all stay.  No rows give no rows.
    """
    if unique_ids(docs):
        found = near_duplicates(docs, n=n, percent=percent, k=k)
        return without(docs, cut(found.where("not kept").select("doc_id")))
    mark = clean_name(docs, "near_row")
    numbered = cut(docs.withColumn(mark, F.monotonically_increasing_id()))
    view = numbered.select(F.col(mark).alias("doc_id"), "text")
    # components are named by row number here; the row of the smallest doc_id stays
    member = near_duplicates(view, n=n, percent=percent, k=k).select(F.col("doc_id").alias("near_member"), F.col("component_id").alias("near_component"))
    ids = numbered.select(F.col(mark).alias("near_member"), F.col("doc_id").alias("near_id"))
    named = member.join(ids, "near_member").groupBy("near_component").agg(F.min(F.struct(F.col("near_id").isNull().alias("no_id"), "near_id", "near_member")).alias("first"))
    keep = named.select(F.col("first.near_member").alias(mark))
    return numbered.join(keep, mark, "left_semi").drop(mark)
