"""Best-fit packing of token sequences, planned on the histogram of lengths.

A plan is made over counts, not documents: at most ``limit`` lengths, each with
the number of pieces that have it.  Best-fit decreasing over counts fills whole
groups of sequences at a time, so the plan's size depends on ``limit`` alone.
Pieces then take the planned slots by their rank within their length.

Ranks come from sums over hash buckets within a length, so a length that very
many pieces share is ranked by many tasks.
"""

from __future__ import annotations

import os
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, cut, slices, texts_of

LIMIT = 2048
END = 0
TOKENIZER = "word_bpe_49k.json"
ROWS_PER_BUCKET = 1024
#: Words whose ids a worker remembers (about 25 bytes each).
MEMORY = 3_000_000


#: New words are sorted into the others in lots of so many.
LOT = 1 << 17
#: Words encoded at once: an encoding takes some hundreds of bytes until its ids are read.
ENCODED = 4096


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... ``counts[0]`` numbers, then those from starts[1] on, and so forth."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class _Known:
    """Ids of words by the sorted hashes of the words."""

    def __init__(self):
        self.words, self.starts, self.counts, self.flat = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint32)

    def add(self, words: np.ndarray, starts: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        """``words``, none of them known."""
        words = np.concatenate([self.words, words])
        order = np.argsort(words, kind="stable")
        self.words = words[order]
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])[order]
        self.counts = np.concatenate([self.counts, counts.astype(np.int32)])[order]
        self.flat = np.concatenate([self.flat, flat])

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of those that are known, their counts, their ids one behind the other)."""
        if not len(self.words):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), self.flat[:0]
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        have = np.flatnonzero(self.words[at] == words)
        counts = self.counts[at[have]].astype(np.int64)
        return have, counts, self.flat[_ranges(self.starts[at[have]], counts)]


class WordTokenizer:
    """Ids of whole texts by a tokenizer that white space separates.

    White space never is part of a token and nothing that the tokenizer does
    reaches over it, so a text's ids are those of its words in a row, and each
    different word is encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.lately = _Known(), _Known()

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts, flat = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
        for a in range(0, len(words), ENCODED):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words[a : a + ENCODED], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
            flat.append(np.fromiter((x for e in ids for x in e), dtype=np.uint32, count=int(counts[-1].sum())))
        return np.concatenate(counts), np.concatenate(flat)

    def _look_up(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, counts, flat) of the ids of each word."""
        words = vocabulary.to_pylist()
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(words))
        new, found = np.arange(len(h)), []
        for known in (self.known, self.lately):
            have, counts, flat = known.find(h[new])
            found.append((new[have], counts, flat))
            new = np.delete(new, have)
        counts, flat = self._encoded([words[i] for i in new])
        if len(self.known.words) + len(self.lately.words) + len(new) <= MEMORY:
            self.lately.add(h[new], np.cumsum(counts) - counts, counts, flat)
            if len(self.lately.words) > LOT:
                own, self.lately = self.lately, _Known()
                self.known.add(own.words, own.starts, own.counts, own.flat)
        found.append((new, counts, flat))
        place, counts, flat = (np.concatenate(x) for x in zip(*found))
        all_starts, all_counts = np.empty(len(h), dtype=np.int64), np.empty(len(h), dtype=np.int64)
        all_starts[place], all_counts[place] = np.cumsum(counts) - counts, counts
        return all_starts, all_counts, flat

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        words = Words(texts)
        starts, counts, flat = self._look_up(words.vocabulary)
        n = counts[words.ids] if len(words.ids) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        if not ends[-1]:
            return np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        return ends[words.offsets], flat[_ranges(starts[words.ids], n)]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_loaded: dict[str, WordTokenizer] = {}


def _tokenizer(path: str | None) -> WordTokenizer:
    path = path or tokenizer_path()
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def _pieces(batches, path: str | None, limit: int, end: int, with_ids: bool):
    tokenizer = _tokenizer(path)
    for batch in batches:
        for part in slices(batch, "text"):
            offsets, ids = tokenizer.encode(texts_of(part))
            doc = part.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for i in range(part.num_rows):
                own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end)).astype("<u4")
                for k, start in enumerate(range(0, len(own), limit)):
                    piece = own[start : start + limit]
                    rows.append((doc[i], k, start, len(piece), zlib.crc32(piece.tobytes()), piece.tolist() if with_ids else None))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            out = [pa.array(c, t) for c, t in zip(columns, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(out[: 6 if with_ids else 5], names=names[: 6 if with_ids else 5])


def pieces(docs: DataFrame, *, path: str | None = None, limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """Documents as token pieces of at most ``limit`` ids, each document closed by ``end``.

    Null texts are empty texts, whose one piece is ``end`` alone.  ``path``: the
    tokenizer's file, by default word_bpe_49k.json of the public tokenizers.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(partial(_pieces, path=path, limit=limit, end=end, with_ids=with_ids), schema)


def best_fit_plan(histogram: dict[int, int], limit: int = LIMIT) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: (runs, number of sequences).

    A run (length, first_rank, count, sequence, each, offset): ``count`` pieces of
    ``length``, from ``first_rank`` on, lie in sequences from ``sequence`` on, ``each`` to a
    sequence, one behind the other from ``offset`` on.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left: groups of (first sequence, count)
    runs: list[tuple[int, int, int, int, int, int]] = []
    total = 0
    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left, rank = histogram[length], 0

        def place(sequence: int, count: int, room: int) -> None:
            """Fill ``count`` sequences of equal room as far as pieces are left."""
            nonlocal left, rank
            each = room // length
            full = min(count, left // each)
            for n, k in ((full, each), (1 if full < count and left - full * each else 0, left - full * each)):
                if n:
                    k = min(k, each)
                    runs.append((length, rank, n * k, sequence, k, limit - room))
                    if room - k * length:
                        free.setdefault(room - k * length, []).append((sequence, n))
                    left, rank, sequence, count = left - n * k, rank + n * k, sequence + n, count - n
            if count:
                free.setdefault(room, []).append((sequence, count))

        for room in range(length, limit):
            if not left:
                break
            for group in free.pop(room, []):
                if left:
                    place(*group, room)
                else:
                    free.setdefault(room, []).append(group)
        if left:
            need = -(-left // (limit // length))
            start, total = total, total + need
            place(start, need, limit)
    return runs, total


def _slots(batches, plan):
    key, first, sequence, each, offset, lengths = plan.value
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = np.searchsorted(key, (length << 40) + rank, side="right") - 1
        nth = rank - first[at]
        columns = [batch.column(c) for c in batch.schema.names if c != "rank"]
        columns += [pa.array(sequence[at] + nth // each[at], pa.int64()), pa.array(offset[at] + nth % each[at] * lengths[at], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[c for c in batch.schema.names if c != "rank"] + ["sequence_id", "offset"])


def pack(docs: DataFrame, *, path: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """Where each piece of each document lies.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Only
    documents of more than ``limit`` tokens are cut.  Sequences are numbered
    from 0 and filled gapless from offset 0.  Repeated rows and rows of equal
    doc_id are documents of their own.  No rows give no rows.
    """
    spark = docs.sparkSession
    rows = cut(pieces(docs, path=path, limit=limit, end=end))
    n = rows.count()
    buckets = min(4096, -(-n // ROWS_PER_BUCKET)) or 1
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # ``limit`` rows at most
    runs, _ = best_fit_plan(histogram, limit)
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 6)
    lengths, first, _, sequence, each, offset = table.T
    plan = spark.sparkContext.broadcast(((lengths << 40) + first, first, sequence, each, offset, lengths))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.join(before, ["length", "bucket"]).withColumn("rank", F.row_number().over(inside) - 1 + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(partial(_slots, plan=plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, *, path: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """The packed sequences with their ids: sequence_id, length, ids."""
    placed = pack(docs, path=path, limit=limit, end=end).select("doc_id", "piece", "ids_crc32", "length", "sequence_id", "offset")
    again = pieces(docs, path=path, limit=limit, end=end, with_ids=True).select(F.col("doc_id").alias("d"), F.col("piece").alias("p"), F.col("ids_crc32").alias("c"), F.col("length").alias("l"), "ids")
    # rows that are alike in all of this hold the same ids
    again = again.dropDuplicates(["d", "p", "c", "l"])
    both = placed.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("piece") == F.col("p")) & (F.col("ids_crc32") == F.col("c")) & (F.col("length") == F.col("l")))
    parts = both.groupBy("sequence_id").agg(F.sum(both["length"]).alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "length", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
