"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so: at sentence and line ends of any script whose last
characters are of a class that about every eighth has, and, for text without ends, after a
few letters of scripts that put no blanks between words; so equal passages give equal chunks
wherever they stand. ``MIN_CHUNK`` only keeps chunks from getting tiny, ``MAX_CHUNK`` cuts
what has neither. A chunk's identifier is its SHA-256; the recipe of a text is the ordered list of its
chunks' identifiers and is computed beside the text, without a shuffle.

An identifier is verified by gathering the chunks themselves once, combined before the
shuffle: it must stand for one body. After that only recipes move: they are grouped, and the
groups of two or more are joined back. Texts whose recipe holds an identifier with several
bodies (none is known for SHA-256) are compared whole, so the result is exact in any case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

#: Characters of a chunk, least and most.
MIN_CHUNK, MAX_CHUNK = 64, 8192
_LAST = r"[acegikmoqsuwyACEGIKMOQSUWY\P{ASCII}]{3}"
#: Where a chunk may end: after every second letter of the alphabet, or any beyond it, three times, and an end; or
#: after a letter out of about every fortieth of the unspaced scripts (by place in their blocks), after another.
#: The last character is looked at first, by a test that nearly all places of a text fail at once.
BOUNDARY = (
    rf"(?:(?<=[\n.!?])(?<={_LAST}.)|(?<=\P{{ASCII}})(?:"
    rf"(?<={_LAST}[\u061f\u06d4\u0964\u0965\u203c-\u2049\u3002\uff01\uff0e\uff1f\uff61])"
    r"|(?<=\P{ASCII}[\u0e01\u0e19\u0e81\u1001\u1780\u3044\u306e\u30f3\u4e00-\u4e2f\u5000-\u503f\u5b50-\u5b8f\u6000-\u602f\u7000-\u702f\u8a00-\u8a2f])))"
)


def sha256(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK, boundary: str = BOUNDARY) -> Column:
    """The text's chunks in order; together they are the text. An empty text has none."""
    pattern = rf"(?s).{{{least},{most}}}?{boundary}|(?s).{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def unverified(docs: DataFrame, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """``identifier``: those that stand for more than one chunk body."""
    bodies = docs.select(F.explode(chunks(F.coalesce(F.col(text_col), F.lit("")))).alias("body"))
    dictionary = bodies.select(digest(F.col("body")).alias("identifier"), "body").distinct()
    return dictionary.groupBy("identifier").agg(F.count("*").alias("bodies")).where("bodies > 1").select("identifier")


def duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256``: which row of equal texts stays.

    Texts are compared unchanged; of equal ones the row with the largest id stays.

    Defined results: null counts as empty, and empty texts equal each other; a null id is
    never the largest, and in a group of null ids only every row is kept; rows that repeat
    the kept id are all kept; repeated rows come back as often as they came; other columns
    of the input are not looked at; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    recipe = F.transform(chunks(text), digest)
    listed = docs.select(F.col(id_col), recipe.alias("recipe"), F.sha2(text, 256).alias("text_sha256"))
    recipes = stored(listed.withColumn("whole", F.lit(None).cast("string")), "recipes")
    doubted = stored(unverified(docs, text_col, digest), "unverified")
    if not doubted.isEmpty():
        lists = recipes.select("recipe", F.explode("recipe").alias("identifier")).join(doubted, "identifier", "left_semi").select("recipe").distinct()
        whole = docs.select(F.col(id_col), recipe.alias("recipe"), F.sha2(text, 256).alias("text_sha256"), text.alias("whole"))
        recipes = stored(recipes.join(lists, "recipe", "left_anti").select(whole.columns).union(whole.join(lists, "recipe", "left_semi").select(whole.columns)), "recipes")
    groups = recipes.groupBy("recipe", "whole").agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size"))
    # written, so that the join below can cut the rows of a hot recipe
    repeated = stored(groups.where("group_size > 1"), "repeated").select(F.col("recipe").alias("r"), F.col("whole").alias("w"), "keep_id", "group_size")
    joined = recipes.join(repeated, (F.col("recipe") == F.col("r")) & F.col("whole").eqNullSafe(F.col("w")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return joined.select(
        id_col, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col(id_col).eqNullSafe(keep).alias("kept"), "text_sha256"
    )
