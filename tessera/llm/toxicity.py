"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over character n-grams of words is trained with numpy from
confirmed toxic texts and unlabelled ones.  Its risk estimator takes the
positives' share of the unlabelled texts (the class prior) off their risk as
negatives and never lets that part fall below zero.

The features, n-grams whose share among the positives is far from that among
the unlabelled texts, are chosen by counts that executors gather; the driver
sees the chosen ones and the sample's texts in terms of them.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, clean_name, cut, mix64, slices, texts_of, unique_ids, without

#: At most so many texts, as expected, are drawn for the training.
POSITIVES, UNLABELLED = 3000, 6000
FEATURES = 600
#: Standard errors that an n-gram's share among positives must be off to be a feature.
LEAST_Z = 5.0
LEAST_TEXTS = 3
#: Bytes of text whose n-grams are counted at once; they take about 100 times as much.
GRAM_BYTES = 1 << 19
STEPS = 300
FOLDS = 5
#: Bytes of an n-gram of a word that is closed by a mark on either side.
GRAMS = (4, 6, 8)
TRIM = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are not to be learnt."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(True))


def word_grams(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, gram): the hashed n-grams of each word, trimmed of ASCII signs."""
    trimmed = pc.ascii_trim(vocabulary.cast(pa.large_string()), characters=TRIM).cast(pa.large_binary())
    closed = pc.binary_join_element_wise(pa.scalar(b"\x02", pa.large_binary()), trimmed, pa.scalar(b"\x03", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    if not len(closed):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(b"".join(closed.to_pylist()), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(closed)), pc.binary_length(closed).to_numpy(zero_copy_only=False))
    words, grams = [], []
    for n in GRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + data[k : k + m]
        inside = np.flatnonzero(owner[:m] == owner[n - 1 :])
        words.append(owner[inside])
        grams.append(mix64(h[inside]))
    return (np.concatenate(words), np.concatenate(grams)) if words else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))


def text_grams(texts: pa.Array, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values): each text's different n-grams, of those in ``among`` (sorted) if it is given."""
    words = Words(texts, lower=True)
    word, gram = word_grams(words.vocabulary)
    if among is not None:
        k = np.minimum(np.searchsorted(among, gram), max(len(among) - 1, 0))
        have = among[k] == gram if len(among) else np.zeros(len(gram), dtype=bool)
        word, gram = word[have], gram[have]
    order = np.argsort(word, kind="stable")
    gram, counts = gram[order], np.bincount(word, minlength=len(words.vocabulary))
    start = np.cumsum(counts) - counts
    of, ids = words.owner(), words.ids
    some = counts[ids] > 0 if len(ids) else np.zeros(0, dtype=bool)
    pair = np.unique(of[some] * np.int64(max(len(counts), 1)) + ids[some])
    of, ids = pair // max(len(counts), 1), pair % max(len(counts), 1)
    n = counts[ids] if len(ids) else np.zeros(0, dtype=np.int64)
    pick = np.arange(n.sum()) + np.repeat(start[ids] - (np.cumsum(n) - n), n) if len(n) else np.zeros(0, dtype=np.int64)
    values, of = gram[pick], np.repeat(of, n)
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[new], of[new]
    return np.searchsorted(of, np.arange(len(words) + 1)), values


def _gram_counts(batches):
    """Texts of each side that hold an n-gram, summed over a part."""
    for batch in batches:
        for part in slices(batch, "text", GRAM_BYTES):
            side = part.column("positive").to_numpy(zero_copy_only=False)
            at, values = text_grams(texts_of(part))
            grams, inverse = np.unique(values, return_inverse=True)
            positive = np.bincount(inverse, weights=np.repeat(side, np.diff(at)), minlength=len(grams)).astype(np.int64)
            total = np.bincount(inverse, minlength=len(grams)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(positive), pa.array(total - positive)], names=["gram", "p", "u"])


def _features(batches, grams):
    for batch in batches:
        for part in slices(batch, "text"):
            at, values = text_grams(texts_of(part), grams.value)
            yield pa.RecordBatch.from_arrays([part.column("positive"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))], names=["positive", "grams"])


class Model:
    """``score`` = sigmoid(bias + sum of the weights of the n-grams that a text has)."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(grams)
        self.grams, self.weights, self.bias = grams[order], weights[order], bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        at, values = text_grams(texts, self.grams)
        found = self.weights[np.searchsorted(self.grams, values)] if len(values) else np.zeros(0)
        total = np.concatenate([[0.0], np.cumsum(found)])
        return 1 / (1 + np.exp(-np.clip(self.bias + total[at[1:]] - total[at[:-1]], -30, 30)))


#: What is known without positives or without unlabelled texts.
NOTHING = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -2.0)


def choose_grams(rows: DataFrame, n_p: int, n_u: int, most: int = FEATURES) -> np.ndarray:
    """The n-grams whose share among positives is the most standard errors off that among the unlabelled."""
    counts = rows.mapInArrow(_gram_counts, "gram long, p long, u long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= LEAST_TEXTS)
    both = (F.col("p") + F.col("u")) / F.lit(n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(both * (1 - both) * F.lit(1 / n_p + 1 / n_u) + F.lit(1e-12))
    best = counts.withColumn("z", z).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "gram").limit(most)
    return np.sort(best.select("gram").toArrow().column("gram").to_numpy().view(np.uint64))


def train(tokens: np.ndarray, p_at, p_values, u_at, u_values, prior: float, *, steps: int = STEPS, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Non-negative PU learning with the sigmoid loss, full batches and Adam.

    The risk is prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)); while the
    second part is below zero the step only leads it back.
    """
    if len(p_at) < 2 or len(u_at) < 2 or not 0 < prior < 1 or not len(tokens):
        return NOTHING
    sides = [(np.repeat(np.arange(len(at) - 1), np.diff(at)), np.searchsorted(tokens, values), len(at) - 1) for at, values in ((p_at, p_values), (u_at, u_values))]
    w, b = np.zeros(len(tokens)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(tokens) + 1), np.zeros(len(tokens) + 1)
    for step in range(1, steps + 1):
        risks, slopes = [], []
        for row, k, n in sides:
            s = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[k], minlength=n) + b, -30, 30)))
            g = s * (1 - s) / n  # of the mean loss as negatives; as positives it is the opposite
            risks.append(s.mean())
            slopes.append(np.append(np.bincount(k, weights=g[row], minlength=len(tokens)), g.sum()))
        negative, back = risks[1] - prior * risks[0], slopes[1] - prior * slopes[0]
        g = (back - prior * slopes[0] if negative >= 0 else -back) + decay * np.append(w, 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(tokens, w, b)


def fit(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from the labels of rows that are not held out.

    The samples are chosen by hashes of doc_id: all if the tables are small, else
    about ``positives`` and ``unlabelled`` of them.  The prior is the toxic share of
    the labelled rows.  A row with several labels is toxic if one says so.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    draw = lambda seed, share: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    chosen = known.where("toxic = 1").where(draw(1, positives / max(n_toxic, 1))).select("doc_id").limit(2 * positives)
    chosen = spark.createDataFrame(chosen.toArrow()) if n_toxic else chosen
    base = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    p = base.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", F.lit(True).alias("positive"))  # 2 * positives ids at most
    u = base.where(draw(2, unlabelled / max(docs.count(), 1))).select("text", F.lit(False).alias("positive"))
    with Scratch(spark) as scratch:
        rows = scratch.cut(p.union(u))
        n_p, n_u = rows.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
        if not n_p or not n_u:
            return NOTHING
        grams = choose_grams(rows, n_p, n_u)
        found = rows.mapInArrow(partial(_features, grams=spark.sparkContext.broadcast(grams)), "positive boolean, grams array<long>").toArrow()
    sides = []
    for side in (True, False):
        own = found.filter(pc.equal(found.column("positive"), side)).column("grams").combine_chunks()
        lengths = pc.list_value_length(own).to_numpy(zero_copy_only=False)
        sides += [np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), own.flatten().to_numpy(zero_copy_only=False).view(np.uint64)]
    return train(grams, *sides, prior=n_toxic / n if n else 0.0)


def _scored(batches, model):
    for batch in batches:
        for part in slices(batch, "text"):
            s = model.value.scores(texts_of(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Null texts are empty texts.  A null doc_id counts as held out.  Without any
    toxic label every text gets the same low score.  Equal texts, repeated rows
    among them, have equal scores; texts of any length are read whole.  No rows
    give no rows; columns other than doc_id and text are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **sizes))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(partial(_scored, model=model), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns whatever their names.

    Null and empty texts are scored as texts without features.  Rows that are
    alike are judged alike.  Where doc_id does not tell rows apart, a written
    copy of ``docs`` is numbered.  No rows give no rows.
    """
    mark = "doc_id"
    if not unique_ids(docs):
        mark = clean_name(docs, "toxic_row")
        docs = cut(docs.withColumn(mark, F.monotonically_increasing_id()))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **sizes))
    rows = docs.select(F.col(mark).alias("doc_id"), "text", F.lit(False).alias("held_out"))
    scored = rows.mapInArrow(partial(_scored, model=model), "doc_id long, held_out boolean, score double, predicted int")
    out = without(docs, cut(scored.where("predicted = 1").select(F.col("doc_id").alias(mark))), mark)
    return out if mark == "doc_id" else out.drop(mark)
