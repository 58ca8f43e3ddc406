"""Row lineage: operators that carry the ids of the source rows along.

A :class:`Trace` holds a DataFrame with hidden columns: ``__trace``, the ids of the
rows a row comes from (one per joined source); ``__ordinal``, its position in the last
exploded collection; ``__overflow``, whether its lineage is not known.
Ids are built from key columns, so they are the same in every plan and every run. A group
has an id of its own, and a table of edges with a row per contribution, however many.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pipeops.functions import as_column, key_struct
from pipeops.operators import joins, shaping
from pipeops.operators.aggregates import ROW_COUNT

HIDDEN = ("__trace", "__ordinal", "__overflow")


@dataclass(frozen=True, eq=False)
class Step:
    """``label`` is the name, with a number where an earlier step has it already: it begins the ids a step gives."""

    name: str
    label: str
    kind: str
    parents: tuple[Step, ...]
    make: Callable[..., DataFrame]
    known: bool
    dropped: tuple[DataFrame, ...] = ()
    edges: DataFrame | None = None


def _ids(source: str, keys: Sequence[Column]) -> Column:
    """The label of a source or group step and its keys, split by colons; those within are escaped, and null is ``\\N``."""
    def part(key: Column) -> Column:
        text = key.cast("string")
        return F.coalesce(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:")), F.lit("\\N"))

    return F.concat_ws(":", F.lit(source.replace("\\", "\\\\").replace(":", "\\:")), *[part(k) for k in keys])


def _visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in HIDDEN]


@dataclass(frozen=True)
class Trace:
    """A traced DataFrame. Every method returns a new trace with one more step."""

    df: DataFrame
    steps: tuple[Step, ...] = field(default=())
    known: bool = True

    @classmethod
    def start(cls, df: DataFrame, keys: Sequence[str], name: str) -> Trace:
        if not keys:
            raise ValueError("a trace needs key columns to name its rows by")
        traced = df.select(
            "*",
            F.array(_ids(name, [F.col(k) for k in keys])).alias("__trace"),
            F.lit(None).cast("int").alias("__ordinal"),
            F.lit(False).alias("__overflow"),
        )
        return cls(traced, (Step(name, name, "source", (), lambda: traced, True),))

    def _label(self, name: str, others: Sequence[Trace] = ()) -> str:
        taken = {s.label for t in (self, *others) for s in t.steps}
        label, number = name, 1
        while label in taken:
            number += 1
            label = f"{name}#{number}"
        return label

    def _next(
        self,
        name: str,
        kind: str,
        make: Callable[..., DataFrame],
        dropped: Sequence[DataFrame] = (),
        others: Sequence[Trace] = (),
        known: bool = True,
        edges: DataFrame | None = None,
    ) -> Trace:
        known = known and self.known and all(o.known for o in others)
        earlier = list(self.steps)
        for other in others:
            earlier += [s for s in other.steps if all(s is not e for e in earlier)]
        groups = [s.label for s in earlier if s.kind == "aggregate"]
        if len(set(groups)) < len(groups):
            raise ValueError("two branches have aggregates of one name; name them apart, so that their groups' ids differ")
        parents = (self.steps[-1], *[o.steps[-1] for o in others])
        step = Step(name, self._label(name, others), kind, parents, make, known, tuple(dropped) if known else (), edges)
        return Trace(make(self.df, *[o.df for o in others]), (*earlier, step), known)

    # Row-local steps keep the ids as they are.

    def filter(self, expression: str | Column, name: str = "filter") -> Trace:
        held = F.coalesce(as_column(expression), F.lit(False))
        return self._next(name, "filter", lambda df: df.where(held), [self.df.where(~held)])

    def select(self, columns: Sequence, name: str = "select") -> Trace:
        wanted = [c for c in _visible(self.df)] if list(columns) == ["*"] else list(columns)
        hidden = [h for h in HIDDEN if h in self.df.columns]
        return self._next(name, "select", lambda df: shaping.select(df, [*wanted, *hidden]))

    def derive(self, column: str, expression: str | Column, name: str = "derive") -> Trace:
        return self._next(name, "derive", lambda df: shaping.derive(df, column, expression))

    def rename(self, mapping: Mapping[str, str], name: str = "rename") -> Trace:
        return self._next(name, "rename", lambda df: shaping.rename(df, mapping))

    def cast(self, column: str, data_type: str, name: str = "cast") -> Trace:
        return self._next(name, "cast", lambda df: shaping.cast(df, column, data_type))

    def union(self, other: Trace, name: str = "union") -> Trace:
        return self._next(name, "union", DataFrame.unionByName, others=[other])

    def explode(self, column: str, target: str, name: str = "explode", outer: bool = True) -> Trace:
        """Copies of a row share its ids and differ in ``__ordinal``."""

        def make(df: DataFrame) -> DataFrame:
            return shaping.posexplode(df.drop("__ordinal"), column, target, "__ordinal", outer)

        none = F.coalesce(F.size(F.col(column)), F.lit(0)) <= 0
        return self._next(name, "explode", make, [] if outer else [self.df.where(none)])

    def output(self, name: str = "output") -> Trace:
        return self._next(name, "output", lambda df: df)

    # Steps that move rows.

    def join(self, other: Trace, condition: str, how: str = "inner", name: str = "join") -> Trace:
        """A joined row has the ids of both sides; rows of either that find no partner and do not go on are lost."""

        def make(left: DataFrame, right: DataFrame) -> DataFrame:
            out = joins.join(left, right, condition, how)
            if "right___trace" not in out.columns:
                return out
            nothing = F.array().cast("array<string>")
            ids = F.array_union(
                F.coalesce("__trace", nothing), F.coalesce("right___trace", nothing)
            )
            both = {
                "__trace": ids,
                "__ordinal": F.coalesce("__ordinal", "right___ordinal"),
                "__overflow": F.coalesce("__overflow", F.lit(False))
                | F.coalesce("right___overflow", F.lit(False)),
            }
            return out.withColumns(both).drop(*[f"right_{h}" for h in HIDDEN])

        lost = []
        if how in ("inner", "left_semi", "semi", "right", "right_outer"):
            lost.append(joins.join(self.df, other.df, condition, "left_anti"))
        elif how in ("left_anti", "anti"):
            lost.append(joins.join(self.df, other.df, condition, "left_semi"))
        if how in ("inner", "left", "left_outer"):
            met = joins.join(self.df, other.df, condition, "right").where("__trace IS NULL")
            lost.append(met.select(F.col("right___trace").alias("__trace")))
        return self._next(name, "join", make, lost, [other])

    def aggregate(
        self,
        group_by: Sequence[str],
        aggregations: Sequence[Mapping[str, str]] = ROW_COUNT,
        name: str = "aggregate",
    ) -> Trace:
        """A group has one id, of this step's label and its keys; :meth:`contributions` has
        an edge for every row that went into it. Making edges shuffles nothing.
        """
        keys = list(group_by)
        group = _ids(self._label(name), [F.col(f"__key.k{i}") for i in range(len(keys))])

        def keyed(df: DataFrame) -> DataFrame:
            return df.withColumn("__key", key_struct(keys) if keys else F.struct(F.lit(1)))

        def make(df: DataFrame) -> DataFrame:
            grouped = keyed(df).groupBy("__key").agg(
                *[as_column(a["expression"]).alias(a["alias"]) for a in aggregations],
                F.max("__overflow").alias("__more"),
            )
            return grouped.select(
                *[F.col(f"__key.k{i}").alias(k) for i, k in enumerate(keys)],
                *[a["alias"] for a in aggregations],
                F.array(group).alias("__trace"),
                F.lit(None).cast("int").alias("__ordinal"),
                F.coalesce("__more", F.lit(False)).alias("__overflow"),
            )

        edges = keyed(self.df).select(F.lit(name).alias("step"), group.alias("group_id"), F.explode("__trace").alias("trace_id"))
        return self._next(name, "aggregate", make, edges=edges)

    def custom(self, fn: Callable[[DataFrame], DataFrame], name: str = "custom") -> Trace:
        """After a user function the lineage is unknown. It sees no hidden columns."""

        def make(df: DataFrame) -> DataFrame:
            return shaping.custom(df.select(*_visible(df)), fn).select(
                "*",
                F.array().cast("array<string>").alias("__trace"),
                F.lit(None).cast("int").alias("__ordinal"),
                F.lit(True).alias("__overflow"),
            )

        return self._next(name, "custom", make, known=False)

    # Answers.

    def rows(self) -> DataFrame:
        """The result without the hidden columns."""
        return self.df.select(*_visible(self.df))

    def lineage(self) -> DataFrame:
        """The result with ``trace_ids``, ``trace_ordinal`` and ``trace_overflow`` (lineage not known)."""
        return self.df.select(
            *_visible(self.df),
            F.col("__trace").alias("trace_ids"),
            F.col("__ordinal").alias("trace_ordinal"),
            F.col("__overflow").alias("trace_overflow"),
        )

    def report(self) -> DataFrame:
        """One row per step: ``(ordinal, step, type, rows_in, rows_out, status)``.

        The steps are put together once more, each with an observed count, and the last one is
        run: one job that reads every source once counts them all, here and now. Like all
        observed counts they are of the work done: if an executor is lost, rows of a task that
        is repeated after a shuffle may count twice; run the report again then.
        """
        made: dict[int, DataFrame] = {}
        seen: dict[int, Observation] = {}
        for i, step in enumerate(self.steps):
            seen[i] = Observation(f"step {i} of {id(self)}")
            inputs = [made[self.steps.index(parent)] for parent in step.parents]
            made[i] = step.make(*inputs).observe(seen[i], F.count(F.lit(1)).alias("n"))
        made[len(self.steps) - 1].write.format("noop").mode("overwrite").save()
        out = [self._observed(seen[i], made[i]) for i in range(len(self.steps))]
        rows = [
            (i, s.name, s.kind, sum(out[self.steps.index(p)] for p in s.parents), out[i], "known" if s.known else "unknown")
            for i, s in enumerate(self.steps)
        ]
        schema = "ordinal int, step string, type string, rows_in long, rows_out long, status string"
        return self.df.sparkSession.createDataFrame(rows, schema)

    @staticmethod
    def _observed(seen: Observation, made: DataFrame) -> int:
        """The observed count, or a count of its own where the optimizer left the step out (next to an empty input)."""
        try:
            return seen.get["n"]
        except Exception:  # noqa: BLE001  the gateway has no error of its own for a missing row
            return made.count()

    def contributions(self) -> DataFrame:
        """``(step, group_id, trace_id)``: an edge from every group to each row it was made of.

        A row that came in several copies (by an explosion or a join) has an edge for each.
        """
        edges = [s.edges for s in self.steps if s.edges is not None]
        if not edges:
            nothing = self.df.select(*[F.lit("").alias(c) for c in ("step", "group_id", "trace_id")])
            return nothing.where("false")
        return reduce(DataFrame.unionByName, edges)

    def fates(self) -> DataFrame:
        """The source ids that did not go on, with the step that dropped them:
        ``(trace_id, step, type)``. A lost group counts for all rows it was made of.
        Ids in no row here reached the end or a step of unknown lineage.
        """
        lost = [
            dropped.select(
                F.explode("__trace").alias("trace_id"),
                F.lit(s.name).alias("step"),
                F.lit(s.kind).alias("type"),
            )
            for s in self.steps
            for dropped in s.dropped
        ]
        if not lost:
            return self.df.select(
                F.explode("__trace").alias("trace_id"), F.lit("").alias("step"), F.lit("").alias("type")
            ).where("false")
        found = reduce(DataFrame.unionByName, lost)
        # Groups may hold groups: the later steps' edges are followed first.
        for s in reversed(self.steps):
            if s.edges is not None:
                edge = s.edges.select(F.col("group_id").alias("trace_id"), F.col("trace_id").alias("__from"))
                found = found.join(edge, "trace_id", "left").select(
                    F.coalesce("__from", "trace_id").alias("trace_id"), "step", "type"
                )
        return found
