"""Suffix automata of reference shards and the matching statistics of documents."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, slices, texts_of

#: Words of a reference shard; its automaton has at most twice as many states.
SHARD_WORDS = 100_000


class SuffixAutomaton:
    """All substrings of a set of word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words) -> None:
        """Add a sequence; matches never run from one sequence into another."""
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            cur, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = cur

    def statistics(self, words):
        """For each word the length of the longest match that ends there."""
        state = matched = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            yield matched

    def spans(self, words, least: int) -> list[list[int]]:
        """Maximal spans [start, end) covered by matches of ``least`` words or more."""
        out: list[list[int]] = []
        for end, n in enumerate(self.statistics(words), 1):
            if n >= least:
                if out and end - n <= out[-1][1]:
                    out[-1][0], out[-1][1] = min(out[-1][0], end - n), end
                else:
                    out.append([end - n, end])
        return out


def _removed(batches, shard, least: int):
    automaton = SuffixAutomaton()
    for text in shard.value:
        automaton.add(_words(text))
    for batch in batches:
        for part in slices(batch, "text"):
            left, spans = [], []
            for text, before in zip(texts_of(part).to_pylist(), part.column("spans").to_pylist()):
                words = _words(text)
                found = before + automaton.spans(words, least)
                spans.append(found)
                left.append(text)
            columns = [pa.array(spans, pa.list_(pa.list_(pa.int64()))) if c == "spans" else part.column(c) for c in part.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def reference_shards(texts: list[str], shard_words: int = SHARD_WORDS) -> list[list[str]]:
    """``texts`` in shards of bounded size; a longer text is a shard of its own."""
    out: list[list[str]] = []
    size = shard_words
    for text in texts:
        n = len(_words(text))
        if size + n > shard_words:
            out.append([])
            size = 0
        out[-1].append(text)
        size += n
    return out


def reference_spans(docs: DataFrame, reference: list[str], *, least: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text and ``spans``, the passages of ``least`` words or more that the reference holds.

    The reference is a bounded list of texts.  Each shard's texts are broadcast;
    a task builds the shard's automaton and streams its documents through it.
    Spans of different shards are given as found and may overlap.  Null texts
    have no spans.
    """
    spark = docs.sparkSession
    out = docs.select("doc_id", "text", F.array().cast("array<array<long>>").alias("spans"))
    for shard in reference_shards([t for t in reference if t and t.strip(SPACE_CHARS)], shard_words):
        out = out.mapInArrow(partial(_removed, shard=spark.sparkContext.broadcast(shard), least=least), "doc_id long, text string, spans array<array<long>>")
    return out
