"""Licence statements by an exact set-similarity join with templates.

Text blocks (lines and, for statements that go over several lines, whole texts;
long ones in overlapping windows) are joined with the token sets of licence
templates: a block belongs to a template if it contains at
least ``THRESHOLD`` of its tokens.  The tokens are ordered by their frequency in
all documents, the rarest first.  A block that reaches the threshold holds one
of the first ``|T| - need + 1`` tokens of the template (prefix filter), has
``need`` tokens at least (length filter), and from the place of the first token
in common enough tokens are left in both (positional filter).

Only DataFrame functions are used.  Templates and what follows from them are
constants; the texts of documents never move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Phrases whose every place counts, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Statements in their lower-case words, with their labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may obtain a copy of the license at www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "creativecommons org licenses by"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
)
THRESHOLD = 0.85
BLOCK_WORDS = 40
#: A word, as a Java regex class body: digits, ASCII letters, all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"{WORD}+"), F.lit(0))


def _needed(tokens: list[str], threshold: float) -> int:
    return math.ceil(threshold * len(tokens) - 1e-9)


def held_tokens(text: Column, vocabulary: list[str]) -> tuple[Column, Column]:
    """(number of words, tokens of ``vocabulary`` among them) of a text.

    Lower case of letters beyond ASCII changes neither.
    """
    gap = WORD.replace("[^", "[") + "+"
    parts = F.split(F.lower(text), gap)
    blank = (F.element_at(parts, 1) == "").cast("int") + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - blank).cast("long"), F.array_intersect(F.array(*map(F.lit, vocabulary)), parts)


def token_order(held: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens from the rarest to the most frequent, by documents that hold them."""
    counts = held.select(F.explode("held").alias("token")).groupBy("token").count().collect()  # the vocabulary at most
    found = {r["token"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def blocks(texts: DataFrame) -> DataFrame:
    """(row_id, block, tokens): lines, and texts of several lines as a whole, in windows of BLOCK_WORDS words, half overlapping."""
    step = BLOCK_WORDS // 2
    whole = F.when(F.contains("text", F.lit("\n")), F.array("text")).otherwise(F.array().cast("array<string>"))
    lines = texts.select("row_id", F.explode(F.concat(F.split("text", "\n"), whole)).alias("line"))
    lines = lines.select("row_id", words(F.col("line")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - step), F.lit(step))
    parts = lines.select("row_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, BLOCK_WORDS))).alias("tokens"))
    return parts.select("row_id", F.monotonically_increasing_id().alias("block"), F.array_distinct("tokens").alias("tokens"))


def similar(block_sets: DataFrame, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, block, label, containment) of blocks that reach the threshold of a template."""
    spark = block_sets.sparkSession
    rank = {w: i for i, w in enumerate(order)}
    sets = [(k, label, sorted(set(t.split()), key=rank.get)) for k, (label, t) in enumerate(templates)]
    postings = [(w, k, i) for k, _, t in sets for i, w in enumerate(t[: len(t) - _needed(t, threshold) + 1])]
    postings_df = F.broadcast(spark.createDataFrame(postings, "token string, template int, place int"))
    sets_df = F.broadcast(spark.createDataFrame([(k, label, t, _needed(t, threshold)) for k, label, t in sets], "template int, label string, t_tokens array<string>, need int"))
    own = F.array_intersect(F.array(*map(F.lit, order)), F.col("tokens"))  # in the global order
    held = block_sets.select("row_id", "block", own.alias("own"), F.size("tokens").alias("n"))
    pairs = held.select("row_id", "block", "own", "n", F.posexplode("own").alias("at", "token")).join(postings_df, "token").join(sets_df, "template")
    pairs = pairs.where(F.col("n") >= F.col("need"))
    pairs = pairs.groupBy("row_id", "block", "template").agg(F.min(F.struct("at", "place", "own", "t_tokens", "label", "need")).alias("f")).select("row_id", "block", "f.*")
    pairs = pairs.where(1 + F.least(F.size("own") - 1 - F.col("at"), F.size("t_tokens") - 1 - F.col("place")) >= F.col("need"))
    shared = F.size(F.array_intersect("own", "t_tokens"))
    return pairs.where(shared >= F.col("need")).select("row_id", "block", "label", (shared / F.size("t_tokens")).alias("containment"))


def _starts(phrase: str) -> Column:
    """Where the words of ``phrase`` stand one behind the other in ``w``."""
    want = phrase.split()
    n = len(want)
    places = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.slice("w", i + 1, n) == F.array(*map(F.lit, want)))


def scan(docs: DataFrame, *, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of ``docs`` with the licences that its text states.

    Columns: doc_id, n_words, n_base (places of the phrases), first_word and
    last_word (smallest and largest start of those, null without any),
    base_labels, labels (templates' labels too; sorted, joined by commas, empty
    without any) and score, the largest share of a template that a block holds,
    1 where a phrase stands.  Null texts are empty texts.
    """
    vocabulary = sorted({w for _, t in templates for w in t.split()} | {w for p in PHRASES for w in p.split()})
    text = F.coalesce("text", F.lit(""))
    count, held = held_tokens(text, vocabulary)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", count.alias("n_words"), held.alias("held"), text.alias("text"))
    # what no block of a document can reach its words cannot either; only texts that may state something are kept
    may = F.lit(False)
    for t in [*(t for _, t in templates), *PHRASES]:
        own = sorted(set(t.split()))
        need = len(own) if t in PHRASES else _needed(own, threshold)
        may = may | (F.size(F.array_intersect("held", F.array(*map(F.lit, own)))) >= need)
    rows = cut(rows.select("row_id", "doc_id", "n_words", "held", F.when(may, F.col("text")).alias("text")))
    order = token_order(rows, vocabulary)
    texts = rows.where("text is not null").select("row_id", "text")
    places = texts.select("row_id", words(F.col("text")).alias("w")).select("row_id", *[_starts(p).alias(f"p{i}") for i, p in enumerate(PHRASES)])
    found = F.concat(*[f"p{i}" for i in range(len(PHRASES))])
    labels = F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(x)) for i, x in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    base = places.select("row_id", F.size(found).cast("long").alias("n_base"), F.array_min(found).cast("long").alias("first_word"), F.array_max(found).cast("long").alias("last_word"), labels.alias("base"))
    by_template = similar(blocks(texts), order, templates, threshold).groupBy("row_id").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    none = F.array().cast("array<string>")
    text_of = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    out = rows.drop("text", "held").join(base, "row_id", "left").join(by_template, "row_id", "left")
    out = out.withColumn("base", F.coalesce("base", none)).withColumn("n_base", F.coalesce("n_base", F.lit(0)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", text_of("base").alias("base_labels"), text_of(F.concat("base", F.coalesce("more", none))).alias("labels"), score.alias("score"))
