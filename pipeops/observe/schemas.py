"""Schemas as rows: differences, contracts, fingerprints and their history.

A *fields table* has the columns ``path, type, nullable, position`` after any key
columns (for instance run and node), one row per field, nested fields as ``a.b``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from pipeops.operators.windows import split_window


def schema_fields(df: DataFrame) -> DataFrame:
    """The fields table of a DataFrame's own schema."""
    rows: list[tuple[str, str, bool, int]] = []

    def visit(struct: StructType, prefix: str) -> None:
        for field in struct.fields:
            path = f"{prefix}{field.name}"
            nested = isinstance(field.dataType, StructType)
            kind = "struct" if nested else field.dataType.simpleString()
            rows.append((path, kind, field.nullable, len(rows)))
            if nested:
                visit(field.dataType, f"{path}.")

    visit(df.schema, "")
    ddl = "path STRING, type STRING, nullable BOOLEAN, position INT"
    return df.sparkSession.createDataFrame(rows, ddl)


def _flat(fields: Column, element: StructType, prefix: Column | None = None) -> Column:
    """An array of ``{name, type, nullable, fields?}`` with nested fields put behind, as
    an array of ``{path, type, nullable, position}``.
    """

    def path(f: Column) -> Column:
        return f["name"] if prefix is None else F.concat(prefix, F.lit("."), f["name"])

    here = F.transform(
        fields,
        lambda f, i: F.struct(
            path(f).alias("path"), f["type"].alias("type"), f["nullable"].alias("nullable"), i.alias("position")
        ),
    )
    nested = [f for f in element.fields if f.name == "fields" and isinstance(f.dataType, ArrayType)]
    if not nested:
        return here
    below = F.transform(
        F.filter(fields, lambda f: f["fields"].isNotNull()),
        lambda f: _flat(f["fields"], nested[0].dataType.elementType, path(f)),
    )
    return F.concat(here, F.flatten(below))


def snapshot_fields(
    snapshots: DataFrame, keys: Sequence[str], column: str = "schema"
) -> DataFrame:
    """The fields table of stored snapshots, arrays of ``{name, type, nullable, fields?}``."""
    element = snapshots.schema[column].dataType.elementType
    return snapshots.select(*keys, F.inline(_flat(F.col(column), element)))


_NO_FIELDS = "array<struct<path:string,type:string,nullable:boolean,position:int>>"


def _changes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of changes from the columns ``__b`` and ``__a``, arrays of fields. Row-local."""

    def paths(fields: Column) -> Column:
        return F.transform(fields, lambda f: f["path"])

    def top_common(fields: Column, others: Column) -> Column:
        return F.filter(
            paths(fields),
            lambda p: ~F.contains(p, F.lit(".")) & F.array_contains(others, p),
        )

    before, after = F.col("__b"), F.col("__a")
    # The outer form: for the inner one Spark adds a filter on the array's size, which
    # would compute the array a second time.
    listed = df.withColumns(
        {
            "__order_b": top_common(before, paths(after)),
            "__order_a": top_common(after, paths(before)),
            "path": F.explode_outer(F.array_union(paths(before), paths(after))),
        }
    ).where("path IS NOT NULL")

    def found(fields: str) -> Column:
        return F.try_element_at(F.filter(fields, lambda f: f["path"] == F.col("path")), F.lit(1))

    met = listed.withColumns({"__fb": found("__b"), "__fa": found("__a")})
    old, new = F.col("__fb"), F.col("__fa")
    moved = F.array_position("__order_b", F.col("path")) != F.array_position(
        "__order_a", F.col("path")
    )
    kind = (
        F.when(old.isNull(), "added")
        .when(new.isNull(), "removed")
        .when(~old["type"].eqNullSafe(new["type"]), "type_changed")
        .when(~old["nullable"].eqNullSafe(new["nullable"]), "nullability_changed")
        .when(moved, "order_changed")
    )
    return (
        met.withColumn("kind", kind)
        .where("kind IS NOT NULL")
        .select(
            *keys,
            "path",
            "kind",
            F.contains(F.col("path"), F.lit(".")).alias("nested"),
            old["type"].alias("before_type"),
            new["type"].alias("after_type"),
            old["nullable"].alias("before_nullable"),
            new["nullable"].alias("after_nullable"),
            F.col("kind").isin("removed", "type_changed").alias("breaking"),
        )
    )


def schema_changes(df: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """What changed between the two snapshots each row holds, one row per changed path.

    ``kind`` is ``added, removed, type_changed, nullability_changed`` or
    ``order_changed`` (a common top-level field stands elsewhere among the common
    ones); ``breaking`` is true for removed fields and changed types. Rows with a
    missing snapshot have no changes. Nothing is shuffled.
    """
    types = {name: df.schema[name].dataType.elementType for name in (before, after)}
    both = df.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    flat = both.select(
        *keys,
        _flat(F.col(before), types[before]).alias("__b"),
        _flat(F.col(after), types[after]).alias("__a"),
    )
    return _changes(flat, list(keys))


def schema_diff(before: DataFrame, after: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same between two fields tables, matched on ``keys``.

    One group holds the fields of one schema, so its size is a number of columns.
    """
    keys = list(keys)
    sides = before.withColumn("__old", F.lit(True)).unionByName(
        after.withColumn("__old", F.lit(False))
    )
    field = F.struct("position", "path", "type", "nullable")
    met = sides.groupBy(*keys).agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(side, field))),
                lambda f: F.struct(f["path"], f["type"], f["nullable"], f["position"]),
            )
            .cast(_NO_FIELDS)
            .alias(name)
            for name, side in (("__b", F.col("__old")), ("__a", ~F.col("__old")))
        ]
    )
    return _changes(met, keys)


def schema_contract_status(
    diff: DataFrame, keys: Sequence[str] = (), mode: str = "block", allow_added: bool = True
) -> DataFrame:
    """``passed``, ``warned`` or ``blocked`` per key group of a schema diff, with the
    number of breaking changes. Groups without any change have no row when keyed.
    """
    if mode not in ("warn", "block"):
        raise ValueError("mode must be warn or block")
    breaking = F.col("breaking") if allow_added else F.col("breaking") | (F.col("kind") == "added")
    counted = diff.groupBy(*keys).agg(F.count_if(breaking).alias("breaking"))
    status = F.when(F.col("breaking") == 0, "passed").otherwise(
        "blocked" if mode == "block" else "warned"
    )
    return counted.select(*keys, status.alias("status"), "breaking")


def schema_fingerprint(schema: str | Column) -> Column:
    """SHA-256 of a snapshot's JSON with its fields in name order, so that the order of
    top-level fields does not matter.
    """
    column = F.col(schema) if isinstance(schema, str) else schema
    return F.sha2(F.to_json(F.array_sort(column)), 256)


def schema_timeline(
    runs: DataFrame,
    snapshots: DataFrame,
    split_by: str | None = "date_trunc('day', created_at)",
) -> DataFrame:
    """Each node's schema over its runs, in order of ``(created_at, run_id)``.

    ``runs(run_id, created_at)`` and ``snapshots(run_id, node_id, schema)`` give rows
    ``(run_id, node_id, created_at, fingerprint, added, removed, type_changed,
    changed)``; ``changed`` means an incompatible change since the node's previous
    snapshot, so an added field alone does not count. ``split_by`` cuts the history
    of a node with very many runs (see :func:`split_window`).
    """
    joined = snapshots.where("schema IS NOT NULL").join(
        runs.select("run_id", "created_at"), "run_id"
    )
    order = ["created_at", "run_id"]
    if split_by is None:
        in_order = Window.partitionBy("node_id").orderBy(*order)
        history = joined.withColumn("__before", F.lag("schema").over(in_order))
    else:
        history = split_window(
            joined, "__before", "lag", order, "schema", ["node_id"], split_by=split_by
        )
    before, now = F.col("__before"), F.col("schema")

    def names(fields: Column) -> Column:
        return F.transform(fields, lambda f: f["name"])

    def types(fields: Column) -> Column:
        return F.transform(fields, lambda f: F.struct(f["name"], f["type"]))

    nothing = F.array().cast("array<string>")
    added = F.array_sort(F.array_except(names(now), names(before)))
    removed = F.array_sort(F.array_except(names(before), names(now)))
    retyped = F.array_sort(
        F.array_intersect(
            names(before), F.transform(F.array_except(types(now), types(before)), lambda f: f["name"])
        )
    )
    return history.select(
        "run_id",
        "node_id",
        "created_at",
        schema_fingerprint("schema").alias("fingerprint"),
        F.coalesce(added, nothing).alias("added"),
        F.coalesce(removed, nothing).alias("removed"),
        F.coalesce(retyped, nothing).alias("type_changed"),
        F.coalesce((F.size(removed) > 0) | (F.size(retyped) > 0), F.lit(False)).alias("changed"),
    )
