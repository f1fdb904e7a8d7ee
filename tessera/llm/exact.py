"""Exact deduplication by content-defined chunk recipes.

A text without white space is cut into chunks at places that its content
defines.  A chunk's identifier is a 128-bit digest; the dictionary of all
different chunks verifies that each digest stands for one content, told by its
SHA-256, and gives contents that clash identifiers of their own.  A text's recipe
is the ordered list of its chunks' identifiers, and two texts are equal when
their recipes are.  Texts are read and chunked once and never move; what moves
are digests and recipes.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, clean_name, cut, unique_ids, without

#: A chunk ends behind the first match of this, at least MIN and at most MAX characters from its start.
CUT_AT = r"[aeiouà-ÿ0-9][dkprstyЀ-鿿](?=[a-t])"
MIN_CHARS, MAX_CHARS = 600, 4000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def chunks(text: Column) -> Column:
    """The consecutive chunks of a text; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{MIN_CHARS},{MAX_CHARS - 1}}}?{CUT_AT}|.{{1,{MAX_CHARS}}}"), F.lit(0))


def _digest(chunk: Column, bits: int) -> Column:
    a, b = F.xxhash64(chunk), F.xxhash64(F.lit(20), chunk)
    if bits < 128:  # weak digests, for tests of the verification
        a, b = F.pmod(a, F.lit(1 << bits)), F.lit(0).cast("long")
    return F.struct(a.alias("a"), b.alias("b"))


def recipes(docs: DataFrame, scratch: Scratch, *, bits: int = 128) -> DataFrame:
    """A row per row of ``docs``: row_id, doc_id, n_code_points, text_sha256, recipe.

    ``row_id`` numbers the rows.  Null texts are empty texts, whose recipe is
    empty.  Chunks of equal digest and different content (none are expected)
    get different identifiers.
    """
    text = F.col("text")
    base = docs.select("doc_id", "text").withColumn("flat", normalised(text))
    part = lambda c: F.struct(_digest(c, bits).alias("digest"), F.unhex(F.sha2(F.encode(c, "utf-8"), 256)).alias("content"))
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    rows = scratch.cut(base.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", size.alias("n_code_points"), F.sha2(F.encode("flat", "utf-8"), 256).alias("text_sha256"), F.transform(chunks(F.col("flat")), part).alias("parts")))
    dictionary = rows.select(F.explode("parts").alias("p")).groupBy("p.digest").agg(F.min("p.content").alias("least"), F.max("p.content").alias("most"))
    clashes = scratch.cut(dictionary.where("least <> most").select("digest"))
    named = F.transform("parts", lambda p: F.struct(p["digest"].alias("digest"), F.lit(0).alias("variant")))
    if clashes.isEmpty():
        return rows.select("row_id", "doc_id", "n_code_points", "text_sha256", named.alias("recipe"))
    return _refined(rows, clashes, scratch)


def _refined(rows: DataFrame, clashes: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with recipes in which each content of a shared digest is a variant of its own."""
    contents = rows.select(F.explode("parts").alias("p")).select("p.digest", "p.content").join(clashes, "digest", "left_semi")
    variants = contents.distinct().withColumn("variant", F.dense_rank().over(Window.partitionBy("digest").orderBy("content")))
    parts = rows.select("row_id", F.posexplode("parts").alias("at", "p")).select("row_id", "at", "p.digest", "p.content")
    parts = parts.join(scratch.cut(variants), ["digest", "content"], "left")
    full = parts.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("at", "digest", F.coalesce("variant", F.lit(0)).alias("variant")))).alias("named"))
    refined = F.transform("named", lambda p: F.struct(p["digest"].alias("digest"), p["variant"].alias("variant")))
    out = rows.drop("parts").join(full, "row_id", "left")
    return scratch.cut(out.select("row_id", "doc_id", "n_code_points", "text_sha256", F.coalesce(refined, F.array().cast("array<struct<digest:struct<a:bigint,b:bigint>,variant:int>>")).alias("recipe")))


def groups(docs: DataFrame, *, bits: int = 128) -> DataFrame:
    """Groups of equal texts, a row per row of ``docs``, dropped ones too.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, n_code_points.
    Of a group the row with the most code points stays, then the smallest
    doc_id (null last), then any one of the rows that are alike in both.  So
    exactly one row of a group is kept.  Null and white-space-only texts are
    one group.  Texts of any length are read whole.  No rows give no rows;
    columns other than doc_id and text are not looked at, whatever their names.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = recipes(docs, scratch, bits=bits)
        best = F.min(F.struct((-F.col("n_code_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
        classes = rows.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size"))
        # written, so that both sides of the join are plain exchanges and a large group's rows can be split
        classes = scratch.cut(classes.select(F.col("recipe").alias("class"), F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), "group_size"))
        out = rows.join(classes, F.col("recipe") == F.col("class"))
        return cut(out.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256", "n_code_points"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns whatever their names.

    Which one is told by ``groups``.  Where doc_id does not tell rows apart, a
    written copy of ``docs`` is numbered and rows that are alike count one by one.
    """
    if unique_ids(docs):
        return without(docs, cut(groups(docs).where("not kept").select("doc_id")))
    mark = clean_name(docs, "exact_row")
    numbered = cut(docs.withColumn(mark, F.monotonically_increasing_id()))
    found = groups(numbered.select(F.col(mark).alias("doc_id"), "text")).select(F.col("doc_id").alias("member"), F.col("keep_id").alias("class"), "n_code_points")
    named = found.join(numbered.select(F.col(mark).alias("member"), F.col("doc_id").alias("id")), "member")
    # groups are named by row number here; the most code points and the smallest doc_id tell which row stays
    first = F.min(F.struct((-F.col("n_code_points")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "member"))
    keep = named.groupBy("class").agg(first.alias("first")).select(F.col("first.member").alias(mark))
    return numbered.join(cut(keep), mark, "left_semi").drop(mark)
