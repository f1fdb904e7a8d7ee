"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, [\x20\x09-\x0D], as a Java regex class body.
SPACE = r"\x20\x09-\x0D"
#: The same characters for Python's str.strip and str.split.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of text that a Python worker holds in its working arrays at once.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``.  Only where that is unset and the master is
    local (tests) a temporary folder of this machine takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: While a table is written: shuffle files go as soon as the job has ended, for nobody reads them after, and
#: Python workers get texts in batches of a few megabytes instead of dozens.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def without_leftovers(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _written(df: DataFrame, folder: str) -> DataFrame:
    spark, path = df.sparkSession, f"{folder}/cut-{uuid.uuid4().hex}"
    with without_leftovers(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    It cuts the lineage, survives the loss of executors, and what stands above
    reads only the columns that it needs.  The table stays; what is needed for a
    while only is cut in a ``Scratch``.
    """
    return _written(df, shared_dir(df.sparkSession))


class Scratch:
    """Tables that are needed until the end of a ``with`` block, in a shared folder of their own.

    What leaves the block must be written by then, by ``cut`` or by that of a
    scratch around it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def release(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def cut(self, df: DataFrame) -> DataFrame:
        return _written(df, self.folder)


def _reach(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package from where the driver did."""
    root = str(Path(__file__).resolve().parents[2])
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, have]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text, runs of characters outside SPACE; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the machine: workers live on through stages, and two share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:  # glibc
        _trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """``batch`` in consecutive parts of about ``limit`` bytes of ``column``.

    A text longer than that is a part of its own; no text is divided.
    """
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))
    give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A column of texts, null as empty, in buffers of its own.

    Some kernels misread arrays whose buffers begin before their first element.
    """
    own = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    return pa.concat_arrays([own, pa.array([], pa.large_string())])


class Words:
    """The words of many texts as one flat array.

    ``ids`` index ``vocabulary``; the words of text i are
    ``ids[offsets[i]:offsets[i + 1]]``.  With ``lower`` the vocabulary has A-Z in
    lower case and may hold a word more than once.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        kept = pc.greater(pc.binary_length(flat), 0)
        before = np.zeros(len(flat) + 1, dtype=np.int64)
        np.cumsum(kept.to_numpy(zero_copy_only=False), out=before[1:])
        coded = flat.filter(kept).dictionary_encode()
        self.offsets = before[bounds]
        self.ids = coded.indices.to_numpy(zero_copy_only=False)
        self.vocabulary = pc.ascii_lower(coded.dictionary) if lower else coded.dictionary

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, in place of its id."""
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocabulary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(self.vocabulary))
        return own[self.ids] if len(own) else np.zeros(0, dtype=np.uint64)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self)), self.counts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit hangs on all bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: An odd number and its inverse modulo 2**64.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def ngram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all ``n`` consecutive elements of ``h`` (across texts too).

    The sum of h[i + k] * step**k modulo 2**64 follows from running sums, so the
    work does not grow with ``n``; ``seed`` takes another step and so gives
    hashes that are independent of those of other seeds.
    """
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    factor = mix_int(seed) | 1
    step, back = _STEP * factor % (1 << 64), _BACK * pow(factor, -1, 1 << 64) % (1 << 64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * _powers(step, len(h)), out=sums[1:])
        out = sums[n:] - sums[:m]
        out *= _powers(back, m)
        out += np.uint64(mix_int(seed + 1))
    return mix64(out)


def mix_int(x: int) -> int:
    return int(mix64(np.array([x + 0x5851F42D], dtype=np.uint64))[0])


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def arrow_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def clean_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not got yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Least and most bits of a Bloom filter, as powers of two: 8 KB to 32 MB, whatever the size of the data.
LEAST_BITS, MOST_BITS = 16, 28


def _bloom_words(batches, bits: int, mixed: bool):
    for batch in batches:
        x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        slot = np.unique((mix64(x) if mixed else x) & np.uint64((1 << bits) - 1))
        yield arrow_batch(word=pa.array((slot >> np.uint64(6)).astype(np.int64)), bits=pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64)))


def bloom(values: DataFrame, mixed: bool = True) -> np.ndarray:
    """A filter of the one long column of ``values``, to broadcast.

    It has 16 to 32 bits a value, but MOST_BITS at most: values beyond that let
    more pass, so it may only save work, never decide.  ``mixed``: the values
    are not hashes.
    """
    from functools import partial

    bits = min(MOST_BITS, max(LEAST_BITS, (16 * values.count()).bit_length()))
    parts = values.mapInArrow(partial(_bloom_words, bits=bits, mixed=mixed), "word long, bits long")
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    with without_leftovers(values.sparkSession):
        rows = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def may_hold(filter_: np.ndarray, values: np.ndarray, mixed: bool = True) -> np.ndarray:
    x = values.view(np.uint64)
    slot = (mix64(x) if mixed else x) & np.uint64(64 * len(filter_) - 1)
    return (filter_[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


#: Most bits of the filter of ``without``: its 2**18 words of 64 bits are broadcast as rows.
WITHOUT_BITS = 24


def unique_ids(docs: DataFrame) -> bool:
    """Whether doc_id tells all rows of ``docs`` apart (null does not)."""
    n, different = docs.select("doc_id").agg(F.count("*"), F.count_distinct("doc_id")).first()
    return n == different


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose ``key``, a unique number, ``gone`` (one column of that name) does not hold.

    Only DataFrame functions.  A filter of a fixed greatest size is broadcast;
    the rows that it does not hold stay where they are, the few others are
    compared with ``gone`` in a join.  ``gone`` should be written.
    """
    bits = min(WITHOUT_BITS, max(LEAST_BITS, (16 * gone.count()).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))
    word, mask, flag = (clean_name(docs, c) for c in ("filter_word", "filter_mask", "filter_hit"))
    one = F.lit(1).cast("long")
    filter_ = gone.select(F.shiftright(slot, 6).alias(word), F.call_function("shiftleft", one, slot.bitwiseAND(63).cast("int")).alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask))
    own = F.call_function("shiftright", F.col(mask), slot.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    marked = docs.withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(filter_), word, "left")  # 2**18 rows at most
    marked = marked.withColumn(flag, F.coalesce(own, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns], flag)
    clear = marked.where(~F.col(flag)).drop(flag)
    met = marked.where(flag).drop(flag).join(gone, key, "left_anti")
    return clear.unionByName(met.select(*[F.col(f"`{c}`") for c in docs.columns]))
