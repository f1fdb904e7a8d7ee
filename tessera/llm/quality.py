"""Quality rules by the distance of a text's histograms from its language's.

Two histograms of a text, of character classes and of common words, are
compared with the mean histograms of the languages in the corpus by the
Jensen-Shannon distance.  A text is judged by the language that it is nearest
to, and only by histograms that rest on enough characters or words.

The references are means over all documents that pass the base rules.  Texts are
read once: their figures and histograms are written, and all else follows from
these.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, Words, cut, ngram_hashes, slices, texts_of

#: Frequent words of the languages, fixed values; all other words are one class more.
COMMON_WORDS = (
    *("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "are", "this", "or", "his", "from", "at", "which", "but", "have", "an", "had", "they"),
    *("le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "pas", "sur", "au", "avec", "est", "il", "par", "ce", "ne", "se", "plus"),
    *("der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "werden", "aus", "hat", "dass", "sie", "nach"),
    *("el", "los", "las", "del", "y", "una", "por", "con", "no", "su", "para", "al", "lo", "como", "más", "o", "pero", "sus", "ha", "me", "si"),
)
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A text stays if both distances (0 to 1) are at most these.
MAX_CHARACTER_DISTANCE = 0.35
#: A text without a common word is at 0.39 to 0.40 from references with 27 to 29 % of them.
MAX_WORD_DISTANCE = 0.35
#: Least characters and words on which a histogram may reject a text.
GUARD_CHARACTERS = 200
GUARD_WORDS = 50

#: Languages with a reference of their own, those of the most documents; all others share one.
MAX_LANGUAGES = 200

LOWER_, UPPER_, DIGIT_, SPACE_, POINT_, SYMBOL_, OTHER_, BEYOND_ = range(8)
N_CLASSES = 8


def _byte_classes() -> np.ndarray:
    """The class of each byte of UTF-8; bytes inside a character have none (-1)."""
    out = np.full(256, OTHER_, dtype=np.int8)
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", LOWER_), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER_), ("0123456789", DIGIT_), (SPACE_CHARS, SPACE_), (".,;:!?'\"()-", POINT_), (SYMBOLS, SYMBOL_)):
        out[[ord(c) for c in chars]] = k
    out[0x80:0xC0] = -1
    out[0xC0:] = BEYOND_
    return out


CLASS_OF = _byte_classes()
_SPACES = np.frombuffer(SPACE_CHARS.encode(), dtype=np.uint8)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the texts."""
    texts = texts.cast(pa.large_binary())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset] if len(texts) else 0
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[start : start + offsets[-1]] if offsets[-1] else np.zeros(0, dtype=np.uint8)
    return offsets, data


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: Words, n: int = 3) -> np.ndarray:
    """Words of each text in ``n``-word windows that occur twice or more in it, the first included."""
    h, owner = words.hashes(), words.owner()
    grams = ngram_hashes(h, n, seed=n)
    hit = np.zeros(len(h) + 1, dtype=np.int64)
    if len(grams):
        inside = np.flatnonzero(owner[: len(grams)] == owner[n - 1 :])
        order = np.lexsort((grams[inside], owner[inside]))
        of, g = owner[inside][order], grams[inside][order]
        same = (of[1:] == of[:-1]) & (g[1:] == g[:-1])
        many = np.zeros(len(of), dtype=bool)
        many[1:] |= same
        many[:-1] |= same
        at = inside[order[many]]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + n, -1)
    return _sums(np.cumsum(hit[:-1]) > 0, words.offsets)


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line of the text."""
    lines = [x for x in text.split("\n") if x.strip(SPACE_CHARS)]
    return len(lines) - len(set(lines))


class Measures:
    """The rules' figures and the histograms of a part's texts."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts)
        offsets, data = _bytes_of(texts)
        kind = CLASS_OF[data] if len(data) else np.zeros(0, dtype=np.int8)
        self.classes = np.stack([_sums(kind == k, offsets) for k in range(N_CLASSES)], axis=1)
        self.n_words = self.words.counts
        self.word_chars = self.classes.sum(axis=1) - self.classes[:, SPACE_]
        self.n_symbols = self.classes[:, SYMBOL_]
        self.n_dup_lines = np.array([duplicate_lines(t) for t in texts.to_pylist()], dtype=np.int64)
        self.n_repeat_words = repeated_words(self.words)
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)
        place = {w: i for i, w in enumerate(COMMON_WORDS)}
        trimmed = pc.utf8_lower(pc.ascii_trim(self.words.vocabulary, characters=".,;:!?'\"()-" + SYMBOLS)).to_pylist()
        bins = len(COMMON_WORDS) + 1
        code = np.fromiter((place.get(w, bins - 1) for w in trimmed), dtype=np.int64, count=len(trimmed))
        of = self.words.owner() * bins + (code[self.words.ids] if len(self.words.ids) else np.zeros(0, dtype=np.int64))
        self.common = np.bincount(of, minlength=len(self.words) * bins).reshape(len(self.words), bins)


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of the rows of ``p`` from ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            x = Measures(texts_of(part))
            figures = [pa.array(getattr(x, name).astype(np.int64)) for name in FIGURES]
            histograms = [pa.FixedSizeListArray.from_arrays(pa.array(h.ravel().astype(np.int32)), h.shape[1]).cast(pa.list_(pa.int32())) for h in (x.classes, x.common)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *figures, pa.array(x.base_failed), *histograms], names=["doc_id", "lang", *FIGURES, "base_failed", "classes", "common"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _histograms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(batch.column("classes"), N_CLASSES), _matrix(batch.column("common"), len(COMMON_WORDS) + 1)


def _profiles(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        both = np.concatenate([shares(h) for h in _histograms(batch)], axis=1)
        for lang in sorted(set(langs.tolist())):
            sums = both[langs == lang]
            k = both.shape[1]
            columns = [pa.array([lang] * k), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, len(sums), dtype=np.int64)), pa.array(sums.sum(axis=0))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bin", "n", "share"])


def language_profiles(measured: DataFrame) -> dict[str, np.ndarray]:
    """Mean histograms of each language over all documents that pass the base rules.

    The languages of the most documents, MAX_LANGUAGES at most, have their own;
    all others are one.  So what is collected is bounded.
    """
    passed = measured.where(~F.col("base_failed")).select(F.coalesce("lang", F.lit("")).alias("lang"), "classes", "common")
    most = [r["lang"] for r in passed.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    folded = passed.withColumn("lang", F.when(F.col("lang").isin(most), F.col("lang")).otherwise("other languages"))
    rows = folded.mapInArrow(_profiles, "lang string, bin int, n long, share double")
    sums = rows.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("share").alias("share")).collect()  # a row per language and bin
    out: dict[str, np.ndarray] = {}
    for r in sums:
        out.setdefault(r["lang"], np.zeros(N_CLASSES + len(COMMON_WORDS) + 1))[r["bin"]] = r["share"] / r["n"]
    return dict(sorted(out.items()))


def _judged(batches, profiles):
    refs = list(profiles.value.values())
    for batch in batches:
        own = _histograms(batch)
        classes, common = map(shares, own)
        best = np.full(batch.num_rows, np.inf)
        by_class, by_word = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for ref in refs:
            c, w = distance(classes, ref[:N_CLASSES]), distance(common, ref[N_CLASSES:])
            far = c / MAX_CHARACTER_DISTANCE + w / MAX_WORD_DISTANCE
            nearer = far < best
            best, by_class, by_word = np.where(nearer, far, best), np.where(nearer, c, by_class), np.where(nearer, w, by_word)
        bad = (by_class > MAX_CHARACTER_DISTANCE) & (own[0].sum(axis=1) >= GUARD_CHARACTERS)
        bad |= (by_word > MAX_WORD_DISTANCE) & (own[1].sum(axis=1) >= GUARD_WORDS)
        failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
        columns = [batch.column(c) for c in ("doc_id", *FIGURES, "base_failed")] + [pa.array(~failed & ~bad), pa.array(by_class), pa.array(by_word)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *FIGURES, "base_failed", "kept", "character_distance", "word_distance"])


def judge(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` with the rules' figures and the verdict ``kept``.

    Null texts have no words and fail.  A null language is a language of its own.
    Where no document passes the base rules there is no reference, and the base
    rules alone decide.  Repeated rows are judged alike and count one by one in
    the references; texts of any length are read whole.  No rows give no rows;
    columns other than doc_id, text and lang are not looked at.
    """
    figures = ", ".join(f"{c} long" for c in FIGURES)
    measured = cut(docs.select("doc_id", "text", "lang").mapInArrow(_measured, f"doc_id long, lang string, {figures}, base_failed boolean, classes array<int>, common array<int>"))
    profiles = docs.sparkSession.sparkContext.broadcast(language_profiles(measured))
    return measured.mapInArrow(partial(_judged, profiles=profiles), f"doc_id long, {figures}, base_failed boolean, kept boolean, character_distance double, word_distance double")
