"""Change feeds applied to a keyed table (SCD type 1)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructField, StructType, VariantType

from pipeops.files import committed, emptied, mark
from pipeops.functions import as_column, predicate
from pipeops.operators.aggregates import latest_per_key


def _sortable(field: StructField) -> Column:
    """The column, or for types without an order a text that has one."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.to_json(e))
        return F.array_join(F.sort_array(entries), ",")
    return F.to_json(column) if isinstance(field.dataType, VariantType) else column


def _ordered(schema: StructType, taken: Sequence[str]) -> list[Column]:
    return [_sortable(field).desc_nulls_last() for field in schema.fields if field.name not in taken]


def _latest(
    changes: DataFrame, keys: Sequence[str], sequence_by: Sequence[str | Column]
) -> DataFrame:
    """Last change per key. Of changes with equal sequence a delete wins, then the row
    that is greatest in its remaining columns.
    """
    order = [as_column(s).desc_nulls_last() for s in sequence_by]
    order += [F.col("__deleted").desc(), *_ordered(changes.schema, [*keys, "__deleted", "__bucket"])]
    return latest_per_key(changes, keys, order)


def _as_list(value: object) -> list:
    return [value] if isinstance(value, str | Column) else list(value)


def _flagged(df: DataFrame, apply_as_deletes: str | Column | None) -> DataFrame:
    deleted = F.lit(False) if apply_as_deletes is None else predicate(apply_as_deletes)
    return df.withColumn("__deleted", deleted)


def cdc_scd1(
    df: DataFrame,
    keys: Sequence[str],
    sequence_by: str | Sequence[str],
    apply_as_deletes: str | Column | None = None,
) -> DataFrame:
    """The table a batch change feed leads to: the last row of every key whose last
    change is not a delete.
    """
    flagged = _flagged(df, apply_as_deletes)
    latest = _latest(flagged, keys, _as_list(sequence_by))
    return latest.where("NOT __deleted").drop("__deleted")


class CdcTarget:
    """The same for a stream of changes, kept on plain Parquet files in hash buckets of the key.

    A micro-batch writes only its own last change per key, with its bucket, and then a marker;
    repeating a batch replaces both. Every ``compact_every`` batches the touched buckets are merged into a new generation of the
    base, and a manifest, written last, names the generation of every bucket. Buckets that no
    batch touched are neither read nor written then, and reading takes them as they are
    without a merge. Generations and batches that neither the manifest nor the one before it
    (which a reader may still be using) refers to are emptied.

    Delete markers stay stored, so a late older change cannot bring a key back. The driver
    holds a row per bucket and the numbers of the batches since the last compaction.
    """

    def __init__(
        self,
        path: str,
        keys: Sequence[str],
        sequence_by: str | Sequence[str],
        apply_as_deletes: str | Column | None = None,
        compact_every: int = 50,
        buckets: int = 16,
    ) -> None:
        if compact_every < 1:
            raise ValueError("compact_every must be at least 1")
        if buckets < 1:
            raise ValueError("buckets must be at least 1")
        self.path = path
        self.keys = list(keys)
        self.sequence_by = _as_list(sequence_by)
        self.apply_as_deletes = apply_as_deletes
        self.compact_every = compact_every
        self.buckets = buckets
        self._folded: int | None = None

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` function. One target writes a path at a time."""
        spark = batch.sparkSession
        if self._folded is None:
            self._folded, _ = self._manifest(spark)
        if batch_id <= self._folded:
            return  # repeated after its compaction: the base has it already
        flagged = _flagged(batch, self.apply_as_deletes)
        latest = _latest(flagged, self.keys, self.sequence_by)
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")
        latest.withColumn("__bucket", bucket).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")
        mark(spark.range(1), f"{self.path}/log/after={self._folded}", "batch", batch_id)
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(spark, flagged.schema)

    def compact(self, spark: SparkSession, schema: StructType) -> None:
        """Merge what came since the last manifest into the base; ``schema`` has ``__deleted``."""
        last, generations = self._manifest(spark)
        batches, touched = self._since(spark, last)
        if not batches:
            return
        upto = max(batches)
        merged = self._merged(spark, schema, generations, batches, touched)
        by_bucket = merged.repartition(F.col("__bucket")).write.mode("overwrite").partitionBy("__bucket")
        by_bucket.parquet(f"{self.path}/bases/generation={upto}")
        now = generations | dict.fromkeys(touched, upto)
        mark(spark.createDataFrame(sorted(now.items()), "bucket int, base long"), f"{self.path}/manifests", "manifest", upto)
        self._folded = upto
        # what neither this manifest nor the one before it needs
        for stale in self._bases(spark) - set(now.values()) - set(generations.values()):
            emptied(spark, f"{self.path}/bases/generation={stale}")
        for number in [-1, *committed(spark, f"{self.path}/manifests", "manifest")][:-2][-2:]:
            for folded in committed(spark, f"{self.path}/log/after={number}", "batch"):
                emptied(spark, f"{self.path}/batches/batch={folded}")

    @staticmethod
    def _stored(schema: StructType) -> StructType:
        return StructType([*schema.fields]).add("__bucket", "integer")

    def _manifest(self, spark: SparkSession) -> tuple[int, dict[int, int]]:
        """The last manifest's number (-1: none) and the generation of each bucket."""
        numbers = committed(spark, f"{self.path}/manifests", "manifest")
        if not numbers:
            return -1, {}
        rows = spark.read.schema("bucket int, base long").parquet(f"{self.path}/manifests/manifest={numbers[-1]}").collect()
        return numbers[-1], {r["bucket"]: r["base"] for r in rows}

    def _bases(self, spark: SparkSession) -> set[int]:
        """Generations that the last few manifests name."""
        numbers = committed(spark, f"{self.path}/manifests", "manifest")[-3:]
        found = spark.read.schema("bucket int, base long").option("basePath", f"{self.path}/manifests").parquet(*[f"{self.path}/manifests/manifest={n}" for n in numbers])
        return {r[0] for r in found.select("base").distinct().collect()}

    def _since(self, spark: SparkSession, last: int) -> tuple[list[int], list[int]]:
        """Batches committed after a manifest, and the buckets they touched."""
        batches = committed(spark, f"{self.path}/log/after={last}", "batch")
        if not batches:
            return [], []
        touched = spark.read.schema("__bucket int").option("basePath", f"{self.path}/batches").parquet(*self._folders(batches)).select("__bucket")
        return batches, sorted(r[0] for r in touched.distinct().collect())

    def _folders(self, batches: list[int]) -> list[str]:
        return [f"{self.path}/batches/batch={b}" for b in batches]

    def _base(self, spark: SparkSession, schema: StructType, generations: dict[int, int]) -> DataFrame | None:
        """The rows of some buckets, each from its generation; other folders are not opened."""
        if not generations:
            return None
        numbers = sorted(set(generations.values()))
        reader = spark.read.schema(self._stored(schema).add("generation", "long")).option("basePath", f"{self.path}/bases")
        rows = reader.parquet(*[f"{self.path}/bases/generation={g}" for g in numbers])
        wanted = [(F.col("generation") == g) & F.col("__bucket").isin([b for b, h in generations.items() if h == g]) for g in numbers]
        return rows.where(reduce(lambda a, b: a | b, wanted)).drop("generation")

    def _merged(self, spark: SparkSession, schema: StructType, generations: dict[int, int], batches: list[int], touched: list[int]) -> DataFrame:
        """Last change per key of the touched buckets, delete markers included."""
        stored = spark.read.schema(self._stored(schema)).option("basePath", f"{self.path}/batches").parquet(*self._folders(batches))
        stored = stored.select(self._stored(schema).names)
        base = self._base(spark, schema, {b: g for b, g in generations.items() if b in set(touched)})
        rows = stored if base is None else stored.unionByName(base)
        return _latest(rows, self.keys, self.sequence_by)

    def run(self, changes: DataFrame, checkpoint: str) -> DataFrame:
        """Apply all changes available now and return the table."""
        if not changes.isStreaming:
            raise ValueError("a CDC target needs a streaming input; use cdc_scd1 for batches")
        query = (
            changes.writeStream.foreachBatch(self.write_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self.read(changes.sparkSession, changes.schema)

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        full = StructType([*schema.fields]).add("__deleted", "boolean")
        last, generations = self._manifest(spark)
        batches, touched = self._since(spark, last)
        parts = [self._base(spark, full, {b: g for b, g in generations.items() if b not in set(touched)})]
        if batches:
            parts.append(self._merged(spark, full, generations, batches, touched))
        found = [p for p in parts if p is not None]
        if not found:
            return spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, found).where("NOT __deleted").drop("__deleted", "__bucket")
