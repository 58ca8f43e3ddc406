"""Captured ``explain`` texts as rows, and what changed between two plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from pipeops.operators.ordering import dealt

# The phase each heading of an extended plan opens.
PHASES = {
    "parsed logical plan": "parsed",
    "analyzed logical plan": "analyzed",
    "optimized logical plan": "optimized",
    "physical plan": "physical",
    "subqueries": "physical",
}
# How the physical join operators bring rows together.
JOINS = {
    "BroadcastHashJoin": "broadcast",
    "BroadcastNestedLoopJoin": "broadcast",
    "SortMergeJoin": "sort_merge",
    "ShuffledHashJoin": "shuffled_hash",
}
# A line of Spark's tree: three characters per level (blanks, or a bar where a branch goes on
# below), the branch itself, the code generation stage, a mark of an unresolved or invalid
# node, and the operator's name, which ends at a blank or an opening bracket.
TREE_LINE = r"^((?:[: ][ ]{2})*(?:[:+]-[ ])?)(?:[*](?:[(]\d+[)])?[ ])?['!]?([A-Z][A-Za-z0-9]*)(?:[ (\[,]|$)"
_COUNT = r"(?i)partitioning[(](?:.*, )?(\d+)[)]"
# A heading, without the blanks that may follow it. (?d) makes . know line feeds only, as lines are cut at those.
_HEADING = r"(?d)^=+ .* =+\z"
# Patterns that are tried at every sign of a text begin with a sign of their own, so that most places fail at once.
_PLAN_ID = r"id=(?<=\b(?:plan_)?id=)\d++"
_EXPRESSION_ID = r"#\d++L?+"


def _phase(heading: Column) -> Column:
    known = F.create_map(*[F.lit(part) for pair in PHASES.items() for part in pair])
    named = F.try_element_at(known, F.lower(F.regexp_replace(heading, r"^=+ | =+$", "")))
    return F.when(heading == "", "unknown").otherwise(F.coalesce(named, F.lit("unknown")))


def plan_nodes(plans: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per operator line of each plan text, whatever the operator.

    ``(keys.., node_index, operator, depth, line, phase, join_strategy, partitioning,
    exchange, raw, normalized)``; expression and plan ids are blanked in ``normalized`` so
    that plans of two runs can be compared. A tree ends at the first empty line after its
    heading; the analyzed plan begins with a line of column types, which is no node. Each
    text is taken apart in its own row, in time linear in its length: it is cut into lines, of
    which only places are kept in arrays; what is told of a node is made where it is a row by
    itself, and only if it is asked for; nothing is shuffled.
    """
    keys = list(keys)
    lines, size = F.col("__lines"), F.size("__lines")

    def placed(of: Column, wanted: Callable[[Column, Column], Column], first: Column) -> Column:
        """The places of the elements that are wanted, counted from ``first``."""
        return F.filter(F.transform(of, lambda x, i: F.when(wanted(x, i), first + i)), lambda i: i.isNotNull())

    def bare(i: Column) -> Column:
        """A line without blanks at its end, and the last line without a carriage return."""
        line = F.get(lines, i)
        return F.rtrim(F.when(i == size - 1, F.regexp_replace(line, r"\r\z", "")).otherwise(line))

    def marks(operator: Column, i: Column) -> Column:
        """Whether a tree begins or ends here, in a line without an operator; a text has a handful of them."""
        return (operator == "") & ((bare(i) == "") | (F.get(lines, i).startswith("=") & bare(i).rlike(_HEADING)))

    heads = F.filter("__marks", lambda i: F.get(lines, i).startswith("="))
    first = F.aggregate(heads, size, lambda least, i: F.least(least, i))
    # what stands before the first heading, whole, and from each heading to the next mark
    trees = F.concat(
        F.array(F.struct(F.lit("unknown").alias("phase"), F.lit(0).alias("start"), first.alias("end"))),
        F.filter(
            F.transform(
                "__marks",
                lambda at, j: F.struct(
                    F.when(F.get(lines, at).startswith("="), _phase(bare(at))).alias("phase"),
                    (at + 1).alias("start"),
                    F.coalesce(F.get("__marks", j + 1), size).alias("end"),
                ),
            ),
            lambda tree: tree["phase"].isNotNull(),
        ),
    )

    def nodes(tree: Column) -> Column:
        start = tree["start"] + F.when(tree["phase"] == "analyzed", 1).otherwise(0)
        return placed(F.slice("__operators", start + 1, F.greatest(F.lit(0), tree["end"] - start)), lambda operator, _: operator != "", start)

    def there(array: str, at: str) -> Column:
        # never null: else a condition on it would have Spark look beforehand whether the array is, and make it once more
        return F.coalesce(F.get(array, at), F.lit(""))

    phases = F.zip_with("__trees", "__nodes", lambda tree, found: F.array_repeat(tree["phase"], F.size(found)))
    # The outer form: for the inner one Spark adds a filter on the array's size, which
    # would compute the array a second time.
    kept = (
        plans.select(*keys, F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n").alias("__lines"))
        .select(*keys, "__lines", F.transform(lines, lambda line: F.regexp_extract(line, TREE_LINE, 2)).alias("__operators"))
        .select(*keys, "__lines", "__operators", placed(F.col("__operators"), marks, F.lit(0)).alias("__marks"))
        .select(*keys, "__lines", "__operators", trees.alias("__trees"))
        .select(*keys, "__lines", "__operators", "__trees", F.transform("__trees", nodes).alias("__nodes"))
        .select(*keys, "__lines", "__operators", F.flatten(phases).alias("__phases"), F.flatten("__nodes").alias("__places"))
        .select(*keys, "__lines", "__operators", "__phases", F.posexplode_outer("__places").alias("node_index", "__place"))
        .where("__place IS NOT NULL")
        .select(
            *keys,
            "node_index",
            there("__operators", "__place").alias("operator"),
            (F.col("__place") + 1).alias("line"),
            there("__phases", "node_index").alias("phase"),
            F.rtrim(there("__lines", "__place")).alias("raw"),
        )
    )

    def blanked(line: Column) -> Column:
        # expression ids last: what a plan id's digits end in may be one
        return F.regexp_replace(F.regexp_replace(line, _PLAN_ID, "id=?"), _EXPRESSION_ID, "#?")

    raw, operator = F.col("raw"), F.col("operator")
    named = F.create_map(*[F.lit(part) for pair in JOINS.items() for part in pair])
    shuffles = operator.isin("Exchange", "RepartitionByExpression")
    count = F.when(F.contains(raw, F.lit("SinglePartition")), "1").otherwise(F.regexp_extract(raw, _COUNT, 1))
    # no id stands before the name, and few lines are exchanges: only those are blanked for it
    moved = F.when(operator.endswith("Exchange") & (operator != "ReusedExchange"), blanked(F.substr(raw, F.instr(raw, operator))))
    # what stands before the name consists of these signs, three a level
    branch = F.length(F.regexp_extract(raw, "^[ :+-]*", 0))
    return kept.select(
        *keys,
        "node_index",
        "operator",
        (branch / 3).cast("int").alias("depth"),
        "line",
        "phase",
        F.try_element_at(named, operator).alias("join_strategy"),
        F.when(shuffles, F.nullif(count, F.lit(""))).cast("int").alias("partitioning"),
        moved.alias("exchange"),
        "raw",
        blanked(raw).alias("normalized"),
    )


_ATTRIBUTES = ("operator", "phase", "join_strategy", "partitioning", "exchange")


def _paired(left: DataFrame, right: DataFrame, keys: list[str], attributes: Sequence[str]) -> DataFrame:
    both = left.withColumn("__side", F.lit("l")).unionByName(right.withColumn("__side", F.lit("r")), allowMissingColumns=True)
    return both.select(*keys, "node_index", *attributes, "__side")


def _comparable_metrics(nodes: DataFrame) -> DataFrame:
    """A map of metrics as a text with its entries in order, so that equal maps are equal texts."""
    if not isinstance(nodes.schema["metrics"].dataType, MapType):
        return nodes
    entries = F.array_sort(F.map_entries("metrics"))
    return nodes.withColumn("metrics", F.when(F.col("metrics").isNotNull(), F.to_json(F.map_from_entries(entries))))


def plan_changes(left: DataFrame, right: DataFrame, keys: Sequence[str], together: bool = False) -> DataFrame:
    """Differences position by position between the nodes of two plans with equal keys.

    One row per position that differs: ``op`` is ``add``, ``remove`` or ``replace``
    (another operator) or ``alter`` (same operator, other attributes), with the
    values before and after and a flag for each attribute that changed on both-sided
    positions. If both sides have a column ``metrics`` (a map, or any value with an order, of
    what a run measured at the node), it is one of the attributes.

    ``together`` says that both sides were dealt by the keys before texts became nodes: then
    nodes meet where they are made. If they were not, Spark shuffles them all the same.
    """
    keys, attributes = list(keys), list(_ATTRIBUTES)
    if "metrics" in left.columns and "metrics" in right.columns:
        left, right = _comparable_metrics(left), _comparable_metrics(right)
        attributes.append("metrics")
    both = _paired(left, right, keys, attributes)
    # most positions have one row a side, so rows meet without being sorted before their shuffle
    met = (both if together else dealt(both, [*keys, "node_index"])).groupBy(*keys, "node_index").agg(
        *[
            F.max(F.when(F.col("__side") == s, F.col(a))).alias(f"{prefix}_{a}")
            for s, prefix in (("l", "before"), ("r", "after"))
            for a in attributes
        ]
    )
    before, after = F.col("before_operator"), F.col("after_operator")

    def differs(name: str) -> Column:
        return (
            before.isNotNull()
            & after.isNotNull()
            & ~F.col(f"before_{name}").eqNullSafe(F.col(f"after_{name}"))
        )

    flags = {f"{a}_changed": differs(a) for a in attributes[1:]}
    altered = _any(list(flags.values()))
    kind = (
        F.when(before.isNull(), "add")
        .when(after.isNull(), "remove")
        .when(before != after, "replace")
        .when(altered, "alter")
    )
    return met.withColumn("op", kind).withColumns(flags).where("op IS NOT NULL")


def _any(tests: Sequence[Column]) -> Column:
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def plan_operator_changes(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Operators found in one of the two plans only: ``(keys.., operator, change)``."""
    keys = list(keys)
    met = dealt(_paired(left, right, keys, ["operator"]), [*keys, "operator"]).groupBy(*keys, "operator").agg(
        F.max(F.col("__side") == "l").alias("l"), F.max(F.col("__side") == "r").alias("r")
    )
    return met.where("l <> r").select(
        *keys, "operator", F.when(F.col("r"), "added").otherwise("removed").alias("change")
    )
