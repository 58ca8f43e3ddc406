"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A batch of changes is turned into signed counts (an insert adds, a delete takes away, a
revision does both), summed before it is shuffled, and written to a folder of its own. Then
one commit row names batch and folder. Totals are the sums over committed folders, so a
batch that is applied again changes nothing, one that broke off before its commit row counts
for nothing and is simply applied again, and the cost of a batch does not depend on the size
of the corpus. ``compact`` folds committed folders into one of the next generation; batches
are committed in the generation that stands, so what a compaction folds needs no list, and
names of folded batches stay in the commit table, where Spark looks a name up.

One writer at a time is assumed. Columns of changes: ``op`` (insert, delete, revise),
``source, lang, tokenizer_version, n_tokens`` and for revisions the same with ``old_`` in front.

Defined results: null source, language or version is a group like any other; a null count is
no tokens but one document; rows with another or no ``op`` change nothing; a repeated row
counts each time, as batches and not rows are recognised; groups without documents and
tokens are left out of totals; an empty batch is committed and changes nothing; other
columns are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
_COMMIT = "batch string, folder string, folds boolean, generation long"
_TOTALS = "source string, lang string, tokenizer_version string, docs long, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """``source, lang, tokenizer_version, docs, tokens``: what the changes add to each group."""
    def side(sign: int, prefix: str):
        return F.struct(*[F.col(prefix + k).cast("string").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("docs"), (sign * F.coalesce(F.col(prefix + "n_tokens").cast("long"), F.lit(0))).alias("tokens"))

    plus, minus = side(1, ""), side(-1, "")
    sides = F.when(F.col("op") == "insert", F.array(plus)).when(F.col("op") == "delete", F.array(minus))
    if {f"old_{k}" for k in [*KEYS, "n_tokens"]} <= set(changes.columns):
        sides = sides.when(F.col("op") == "revise", F.array(side(-1, "old_"), plus))
    return _summed(changes.select(F.explode(sides).alias("x")).select("x.*"))


def _summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return sums.where("docs <> 0 OR tokens <> 0")


class Rollup:
    """Totals in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], _COMMIT).write.mode("append").parquet(f"{self.folder}/commits")

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(_COMMIT).parquet(f"{self.folder}/commits")

    def _generation(self) -> int:
        """The number of the last compaction; 0 before the first."""
        return self._commits().agg(F.max("generation")).first()[0] or 0

    def batches(self) -> DataFrame:
        """The names of all committed batches."""
        return self._commits().where("NOT folds").select("batch").distinct()

    def _write(self, sums: DataFrame, batch: str | None, folds: bool, generation: int) -> None:
        folder = f"{self.folder}/deltas/{uuid.uuid4().hex}"
        sums.write.parquet(folder)
        # the single row is the commit: a job's files appear at once, when it ends
        row = self.spark.createDataFrame([(batch, folder, folds, generation)], _COMMIT)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes; False if it is committed already."""
        if not self.batches().where(F.col("batch") == batch).isEmpty():
            return False
        self._write(signed(changes), batch, False, self._generation())
        return True

    def _live(self) -> list[str]:
        """Folders to sum: the last compaction and what was committed since, the only commits that reach the driver."""
        commits = self._commits().where(F.col("generation") == self._generation())
        first = commits.groupBy("batch", "folds").agg(F.min("folder").alias("folder"))
        return sorted(r["folder"] for r in first.collect())

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer_version, docs, tokens``."""
        folders = self._live()
        rows = self.spark.read.schema(_TOTALS).parquet(*folders) if folders else self.spark.createDataFrame([], _TOTALS)
        return _summed(rows)

    def compact(self) -> None:
        """Writes the totals as one folder that stands for all batches so far."""
        if not self.batches().isEmpty():
            self._write(self.totals().coalesce(1), None, True, self._generation() + 1)


def changes_between(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """The changes that turn one ledger (``key``, groups, ``n_tokens``) into another."""
    columns = [*KEYS, "n_tokens"]
    before = old.select(F.col(key).alias("k"), F.struct(*columns).alias("old"))
    after = new.select(F.col(key).alias("k"), F.struct(*columns).alias("new"))
    both = before.join(after, "k", "full")
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "revise")
    current = F.coalesce("new", "old")
    return both.withColumn("op", op).where("op IS NOT NULL").select("op", *[current[c].alias(c) for c in columns], *[F.col("old")[c].alias(f"old_{c}") for c in columns])
