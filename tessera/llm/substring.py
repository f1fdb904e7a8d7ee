"""Removal of passages that occur earlier in the corpus.

A window is ``length`` consecutive words of one document.  A word goes if a
window covers it whose words also start earlier, that is in a document of
smaller doc_id or further ahead in the same one.

How repeats are found without moving all windows:

1. Every window selects its smallest q-gram hash as its anchor, so equal windows
   have equal anchors.  Anchors that occur in two different texts are hot; a
   filter of bounded size holds them and is broadcast.
2. Only windows with a hot anchor are hashed, in 128 bits, and grouped; what
   counts is the smallest doc_id that holds a window.
3. A window of another document than that is covered.  Documents without such
   windows are finished in place; only the texts of the others are shuffled.

Automata of the whole corpus have no size bound, so they are not broadcast; see
``suffix`` for the automaton over bounded references.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, bloom, cut, list_array, may_hold, ngram_hashes, slices, texts_of, unique_ids

LENGTH = 20
GRAM = 8
#: Documents of null doc_id come from this place on, in the order of a hash of their text.
LAST = 1 << 62


class _Windows:
    """Windows and anchors of the texts of a part."""

    def __init__(self, part: pa.RecordBatch, length: int, gram: int):
        self.words = Words(texts_of(part))
        h, owner = self.words.hashes(), self.words.owner()
        self.h, n = h, max(0, len(h) - length + 1)
        self.start = np.flatnonzero(owner[:n] == owner[length - 1 :]) if n else np.zeros(0, dtype=np.int64)
        self.of = owner[self.start]
        self.length, self.gram = length, gram
        self._hashes: dict[int, np.ndarray] = {}

    def anchors(self) -> np.ndarray:
        """For each window the hash of its anchor."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        low = ngram_hashes(self.h, self.gram)
        span, width, done = len(low), self.length - self.gram + 1, 1
        while done < width:  # the minimum over a width by doubling
            step = min(done, width - done)
            low = np.minimum(low[: span - step], low[step:span])
            span, done = len(low), done + step
        return low[self.start]

    def hashes(self, which: int = 0) -> np.ndarray:
        """The first or second half of the hash of each window."""
        if which not in self._hashes:
            self._hashes[which] = ngram_hashes(self.h, self.length, seed=self.length + which)[self.start] if len(self.start) else np.zeros(0, dtype=np.uint64)
        return self._hashes[which]


def _features(batches, length: int, gram: int):
    """Of each text a digest of its words, their number and its windows' different anchors."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = _Windows(part, length, gram)
            off = w.words.offsets
            digest = [xxhash.xxh3_128_digest(w.h[a:b].tobytes()) for a, b in zip(off, off[1:])]
            anchor, of = w.anchors(), w.of
            new = np.ones(len(of), dtype=bool)  # windows one behind the other mostly share their anchor
            new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
            anchor, bounds = anchor[new], np.searchsorted(of[new], np.arange(len(off)))
            columns = [part.column("ord"), pa.array(digest, pa.binary()), pa.array(w.words.counts, pa.int64()), list_array(anchor.view(np.int64), bounds, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["ord", "digest", "n_words", "anchors"])


def _window_rows(batches, hot, length: int, gram: int):
    for batch in batches:
        for part in slices(batch, "text"):
            w = _Windows(part, length, gram)
            keep = np.flatnonzero(may_hold(hot.value, w.anchors(), mixed=False))
            if not len(keep):
                continue
            of, h = w.of[keep], w.hashes()[keep]
            order = np.lexsort((h, of))
            keep, of, h = keep[order], of[order], h[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            ord_ = part.column("ord").to_numpy(zero_copy_only=False)
            columns = [pa.array(h[new].view(np.int64)), pa.array(w.hashes(1)[keep[new]].view(np.int64)), pa.array(ord_[of[new]], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["window", "check", "ord"])


def _may_repeat(batches, repeated):
    for batch in batches:
        yield batch.filter(pa.array(may_hold(repeated.value, batch.column("window").to_numpy(zero_copy_only=False), mixed=False)))


def _spans(covered: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def _covered(w: _Windows, which: slice, windows: pa.Scalar, checks: pa.Scalar) -> np.ndarray:
    """Which of a text's windows are repeats: of a window further ahead in it or of one that is given."""
    own = w.hashes()[which]
    first = np.zeros(len(own), dtype=bool)
    first[np.unique(own, return_index=True)[1]] = True
    if windows.is_valid and len(own) and len(windows.values):
        given, check = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (windows, checks))
        order = np.argsort(given)
        at = order[np.minimum(np.searchsorted(given, own, sorter=order), len(given) - 1)]
        first &= ~((given[at] == own) & (check[at] == w.hashes(1)[which]))
    return ~first


def _cleaned(batches, length: int, gram: int):
    """What is left of texts; ``windows`` and ``checks`` are covered ones, ``digests`` those of whole copies, null in a document without."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = _Windows(part, length, gram)
            counts, off = w.words.counts, w.words.offsets
            bounds = np.searchsorted(w.of, np.arange(len(counts) + 1))
            windows, checks, digests = (part.column(c) for c in ("windows", "checks", "digests"))
            vocabulary = w.words.vocabulary.to_pylist()
            left, removed, sha, spans = [], [], [], []
            for i in range(len(counts)):
                gone = np.zeros(counts[i], dtype=bool)
                if counts[i] >= length:
                    if digests[i].is_valid and xxhash.xxh3_128_digest(w.h[off[i] : off[i + 1]].tobytes()) in digests[i].as_py():
                        gone[:] = True
                    else:
                        at = np.flatnonzero(_covered(w, slice(bounds[i], bounds[i + 1]), windows[i], checks[i]))
                        step = np.zeros(counts[i] + 1, dtype=np.int64)
                        step[at] += 1
                        step[at + length] -= 1
                        gone = np.cumsum(step[:-1]) > 0
                ids = w.words.ids[off[i] : off[i + 1]]
                text = " ".join([vocabulary[k] for k in ids[~gone]])
                left.append(text)
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(text.encode()).hexdigest())
                spans.append(_spans(gone))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=["doc_id", "n_words", "n_removed", "text", "kept_sha256", "spans"],
            )


def _marks(base: DataFrame, unique: bool, length: int, gram: int, scratch: Scratch) -> DataFrame:
    """(ord, windows, checks, digests) of the documents that have covered windows or are whole copies."""
    spark, kinds = base.sparkSession, {"length": length, "gram": gram}
    early = Scratch(spark)
    features = early.cut(base.mapInArrow(partial(_features, **kinds), "ord long, digest binary, n_words long, anchors array<long>"))
    whole = scratch.cut(features.where(F.col("n_words") >= length).select("ord", "digest"))
    anchors = features.select(F.xxhash64("digest").alias("text"), F.explode("anchors").alias("anchor"))
    hot = anchors.groupBy("anchor").agg(F.min("text").alias("t0"), F.max("text").alias("t1")).where("t0 <> t1")
    hot = spark.sparkContext.broadcast(bloom(early.cut(hot.select("anchor")), mixed=False))
    early.release()
    windows = scratch.cut(base.mapInArrow(partial(_window_rows, hot=hot, **kinds), "window long, check long, ord long"))
    hot.destroy()
    first = windows.groupBy("window", "check").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last")
    first = scratch.cut(first.select("window", "check", "first"))
    repeated = spark.sparkContext.broadcast(bloom(first.select("window"), mixed=False))  # most windows stand in one document alone: they need not move again
    moved = windows.mapInArrow(partial(_may_repeat, repeated=repeated), windows.schema)
    covered = moved.join(first, ["window", "check"]).where(F.col("ord") > F.col("first")).drop("first")
    covered = covered if unique else covered.distinct()
    covered = covered.groupBy("ord").agg(F.collect_list(F.struct("window", "check")).alias("w"))
    covered = scratch.cut(covered.select("ord", F.col("w.window").alias("windows"), F.col("w.check").alias("checks")))
    # windows of equal texts alone have no hot anchor: copies of whole texts are told by their digest
    classes = scratch.cut(whole.groupBy("digest").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last").select("digest", "first"))
    copies = whole.join(classes, "digest").where(F.col("ord") > F.col("first")).groupBy("ord").agg(F.collect_set("digest").alias("digests"))  # rows of one doc_id may differ
    return cut(covered.join(copies, "ord", "full").select("ord", "windows", "checks", "digests"))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_removed, text, kept_sha256, spans.

    ``text`` holds the words that stay, joined by one space; ``spans`` are the
    removed ones as [start, end) in words.  Null texts have no words.  Rows of
    equal doc_id do not remove each other's words.  Rows of null doc_id come
    last, in the order of a hash of their text, and those of equal texts count
    as one document (doc_ids are below 2**62).  Texts of fewer than ``length``
    words stay whole, texts of any length are read whole.  No rows give no rows;
    columns other than doc_id and text are not looked at, whatever their names.
    """
    spark, kinds = docs.sparkSession, {"length": length, "gram": gram}
    behind = F.xxhash64("text").bitwiseAND(LAST - 1) + LAST
    base = docs.select("doc_id", "text", F.coalesce("doc_id", behind).alias("ord"))
    with Scratch(spark) as scratch:
        marks = _marks(base.select("text", "ord"), unique_ids(docs), length, gram, scratch)
    touched = spark.sparkContext.broadcast(bloom(marks.select("ord")))

    @F.pandas_udf("boolean")
    def may_be_touched(x):
        import pandas as pd

        return pd.Series(may_hold(touched.value, x.to_numpy(np.int64)))

    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    alone = base.where(~may_be_touched("ord")).select("doc_id", "text", none("long").alias("windows"), none("long").alias("checks"), none("binary").alias("digests"))
    met = base.where(may_be_touched("ord")).join(marks, "ord", "left").select("doc_id", "text", "windows", "checks", "digests")
    out = "doc_id long, n_words long, n_removed long, text string, kept_sha256 string, spans array<array<long>>"
    return alone.union(met).mapInArrow(partial(_cleaned, **kinds), out)
