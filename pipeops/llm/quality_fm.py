"""Document quality by a factorisation machine.

Features of a text: hashed words (weights of log counts, of unit length), structure
statistics and the recorded length as metadata, each statistic as one of ``BINS`` ranges.
The machine adds to the linear terms the interactions of all pairs of features, by the inner
product of low-rank vectors; the sum over pairs is half the square of the sum less the sum
of squares, so scoring is linear in the features of a text.

Training uses at most ``train_rows`` labelled rows, chosen by a hash of their id: the bound
on what reaches the driver. Scoring runs over Arrow batches beside the texts, no shuffle.

Defined results: a null text counts as empty and is scored by its structure alone; a null
recorded length is a range of its own; labels that are null or neither 0 nor 1 and rows
without an id are not learned from, repeated labels of a document count once (the lowest);
repeated rows are scored each; without any usable label the score is 0.5; a very long text is
described whole, one row at a time; an empty table gives an empty one; other columns of the
input are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of hashed words.
BUCKETS = 1 << 12
#: Ranges of each statistic.
BINS = 12
#: Words whose bucket a worker remembers.
REMEMBERED = 100_000

STATISTICS = (
    "words", "word_length", "distinct_words", "commonest_word", "longest_run", "repeats", "upper", "digits", "symbols",
    "stops", "bars", "not_ascii", "blanks", "lines", "repeated_lines", "line_length", "recorded_length",
)
SIZE = BUCKETS + len(STATISTICS) * BINS

_buckets: dict[str, int] = {}


def _bucket(word: str) -> int:
    found = _buckets.get(word)
    if found is None:
        found = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(_buckets) < REMEMBERED:
            _buckets[word] = found
    return found


def describe(text: str, recorded: int | None):
    """Word buckets with their weights, and the statistics of a text."""
    import numpy as np

    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    total = max(1, len(text))
    words = text.lower().split()
    counts = Counter(words)
    n = max(1, len(words))
    longest = run = repeats = 0
    last = None
    for word in words:
        run = run + 1 if word == last else 1
        repeats += run > 1
        last = word
        if run > longest:
            longest = run
    lines = text.split("\n")
    ascii_letters = raw[65:91].sum() + raw[97:123].sum()
    share = lambda codes: raw[[ord(c) for c in codes]].sum() / total
    statistics = np.array(
        [
            np.log1p(len(words)),
            sum(map(len, words)) / n,
            len(counts) / n,
            max(counts.values(), default=0) / n,
            np.log1p(longest),
            repeats / n,
            raw[65:91].sum() / max(1, ascii_letters),
            raw[48:58].sum() / total,
            share("#$%&*<>{}[]\\^~=+@_/"),
            share(".,;:!?"),
            share("|"),
            raw[128:].sum() / total,
            share(" \t\r\n"),
            np.log1p(len(lines)),
            1 - len(set(lines)) / len(lines),
            np.log1p(len(text) / len(lines)),
            -1.0 if recorded is None else np.log1p(max(0, recorded)),
        ]
    )
    weights: dict[int, float] = {}
    for word, count in counts.items():
        bucket = _bucket(word)
        weights[bucket] = weights.get(bucket, 0) + count
    buckets = np.fromiter(weights, np.int32, len(weights))
    values = np.log1p(np.fromiter(weights.values(), np.float64, len(weights)))
    values /= max(1e-9, np.sqrt((values**2).sum()))
    return buckets, values, statistics


@dataclass
class Machine:
    """Ranges of the statistics, and the weights: constant, linear, low-rank."""

    edges: object
    constant: float
    linear: object
    factors: object
    scale: float = field(default=0.5)

    def features(self, buckets, values, statistics):
        import numpy as np

        ranges = [BUCKETS + j * BINS + int(np.searchsorted(edge, x)) for j, (edge, x) in enumerate(zip(self.edges, statistics, strict=True))]
        return np.concatenate([buckets, np.array(ranges, np.int32)]), np.concatenate([values, np.full(len(ranges), self.scale)])

    def score(self, at, x) -> float:
        """The probability of label 1, by the identity for the sum over pairs."""
        import numpy as np

        vectors = self.factors[at]
        whole = x @ vectors
        pairs = 0.5 * (whole @ whole - (x * x) @ (vectors * vectors).sum(1))
        return float(1 / (1 + np.exp(-np.clip(self.constant + self.linear[at] @ x + pairs, -30, 30))))


def train(rows, *, rank: int = 8, epochs: int = 12, step: float = 0.1, batch: int = 128, penalty: float = 1e-5, seed: int = 7) -> Machine:
    """Fits the machine to ``(buckets, values, statistics, label)`` rows with AdaGrad on the log loss."""
    import numpy as np

    random = np.random.default_rng(seed)
    if not rows:
        return Machine([np.empty(0)] * len(STATISTICS), 0.0, np.zeros(SIZE), np.zeros((SIZE, rank)))
    table = np.array([r[2] for r in rows])
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(table[:, j], cuts)) for j in range(table.shape[1])]
    label = np.array([r[3] for r in rows], np.float64)
    prior = (label.sum() + 1) / (len(label) + 2)
    machine = Machine(edges, float(np.log(prior / (1 - prior))), np.zeros(SIZE), random.normal(0, 0.05, (SIZE, rank)))
    made = [machine.features(*r[:3]) for r in rows]
    seen = {k: np.full(v.shape, 1e-6) for k, v in (("linear", machine.linear), ("factors", machine.factors))}
    seen_constant = 1e-6
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for start in range(0, len(order), batch):
            chosen = order[start : start + batch]
            at = np.concatenate([made[i][0] for i in chosen])
            x = np.concatenate([made[i][1] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), [len(made[i][0]) for i in chosen])
            begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            vectors = machine.factors[at]
            weighted = vectors * x[:, None]
            whole = np.add.reduceat(weighted, begins)
            pairs = 0.5 * (whole**2 - np.add.reduceat(weighted**2, begins)).sum(1)
            margin = machine.constant + np.add.reduceat(machine.linear[at] * x, begins) + pairs
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[chosen]
            slope = error[row] * x / len(chosen)
            unique, where = np.unique(at, return_inverse=True)
            linear = np.bincount(where, slope, len(unique)) + penalty * machine.linear[unique]
            each = slope[:, None] * (whole[row] - weighted)
            factors = np.stack([np.bincount(where, each[:, f], len(unique)) for f in range(rank)], 1) + penalty * machine.factors[unique]
            for name, weights, gradient in (("linear", machine.linear, linear), ("factors", machine.factors, factors)):
                seen[name][unique] += gradient**2
                weights[unique] -= step * gradient / np.sqrt(seen[name][unique])
            constant = error.mean()
            seen_constant += constant**2
            machine.constant -= step * float(constant / np.sqrt(seen_constant))
    return machine


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether the checksum of the id as text falls in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", label_col: str = "quality", train_rows: int = 8000, **fit) -> Machine:
    """A machine from at most ``train_rows`` labelled rows outside the held-out fold."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(id_col).agg(F.min(label_col).alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(train_rows)
    texts = _inputs(docs, id_col, text_col, length_col).join(F.broadcast(chosen), id_col)

    def run(batches):
        import pyarrow as pa

        for read in batches:
            for row in read.to_pylist():
                buckets, values, statistics = describe(row["text"] or "", row["recorded"])
                arrays = [pa.array([row[id_col]], read.schema.field(id_col).type), pa.array([row["label"]], pa.int64())]
                arrays += [pa.array([x], pa.list_(t)) for x, t in ((buckets, pa.int32()), (values, pa.float64()), (statistics, pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, "label", "buckets", "values", "statistics"])

    kind = texts.schema[id_col]
    schema = T.StructType([kind, T.StructField("label", T.LongType())] + [T.StructField(n, T.ArrayType(t)) for n, t in (("buckets", T.IntegerType()), ("values", T.DoubleType()), ("statistics", T.DoubleType()))])
    found = texts.select(id_col, "text", "recorded", F.col("label").cast("long").alias("label")).mapInArrow(run, schema).toArrow().to_pydict()
    rows = sorted(zip(*found.values(), strict=True), key=lambda r: (r[0], r[1], r[4]))
    import numpy as np

    return train([(np.array(b, np.int32), np.array(v), s, label) for _, label, b, v, s in rows], **fit)


def _inputs(docs: DataFrame, id_col: str, text_col: str, length_col: str) -> DataFrame:
    recorded = F.col(length_col).cast("long") if length_col in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(id_col), F.col(text_col).alias("text"), recorded.alias("recorded"))


def accepted(docs: DataFrame, machine: Machine, threshold: float = 0.3, **columns) -> DataFrame:
    """The rows of the input, all their columns unchanged, that score at least ``threshold``."""
    held = docs.select(F.struct(*docs.columns).alias("row"), *(F.col(c) for c in {columns.get("text_col", "text"), columns.get("length_col", "n_chars")} & set(docs.columns)))
    return score(held, machine, id_col="row", **columns).where(F.col("score") >= threshold).select("row.*")


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``id_col, score``: the probability that a document's label is 1. The id may be of any type, a struct too."""
    source = _inputs(docs, id_col, text_col, length_col)

    def run(batches):
        import pyarrow as pa

        for read in batches:
            scores = []
            for text, recorded in zip(read.column(1), read.column(2), strict=True):
                scores.append(machine.score(*machine.features(*describe(text.as_py() or "", recorded.as_py()))))
            yield pa.RecordBatch.from_arrays([read.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    return source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", **options) -> DataFrame:
    """``id_col, held_out, score, predicted``: learned from the labels outside the held-out fold."""
    machine = learn(docs, labels, id_col=id_col, **options)
    columns = {k: v for k, v in options.items() if k in ("text_col", "length_col")}
    scored = score(docs, machine, id_col=id_col, **columns)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
