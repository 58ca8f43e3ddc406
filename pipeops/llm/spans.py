"""Places of pattern matches as rows, in DataFrame functions only.

Splitting a text at a pattern gives what lies between the matches, so a match starts after
the pieces and matches before it. The running sum is a window over the rows of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

#: Characters kept before and after a match.
BEFORE, AFTER = 64, 32


def matches(text: Column, pattern: str, trigger: Column) -> Column:
    """Matches in order, each with the length of the gap before it and its neighbourhood.

    The pattern must not match the empty text. Only texts for which ``trigger`` holds are searched.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    made = F.transform(
        F.arrays_zip(found.alias("found"), between.alias("gap"), F.slice(between, 2, F.size(found)).alias("next")),
        lambda m: F.struct(m["found"].alias("value"), F.length(m["gap"]).alias("gap"), F.right(m["gap"], F.lit(BEFORE)).alias("before"), F.left(m["next"], F.lit(AFTER)).alias("after")),
    )
    return F.when(trigger, F.filter(made, lambda m: m["value"].isNotNull()))


def marked(docs: DataFrame, id_col: str, text_col: str, patterns: dict[str, tuple[str, str]], label: str) -> DataFrame:
    """``row, id_col`` and an array of matches per pattern for every row, written to the shared folder.

    ``patterns``: name to pattern and a pattern that must occur for the first to match.
    ``row`` numbers the rows of the written table; ids may be null or repeat.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = [matches(text, p, text.rlike(t)).alias(f"matches_{name}") for name, (p, t) in patterns.items()]
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), *columns), label)


def rows(table: DataFrame, names: list[str]) -> DataFrame:
    """``row, pattern, value, start, end, before, after``: a row per match, in code points."""
    parts = None
    for name in names:
        found = table.where(F.size(f"matches_{name}") > 0).select("row", F.lit(name).alias("pattern"), F.posexplode(f"matches_{name}").alias("at", "match"))
        parts = found if parts is None else parts.union(found)
    flat = parts.select("row", "pattern", "at", "match.*")
    so_far = Window.partitionBy("row", "pattern").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(so_far)
    return flat.withColumn("end", end.cast("long")).select("row", "pattern", "value", (F.col("end") - F.length("value")).cast("long").alias("start"), "end", "before", "after")
