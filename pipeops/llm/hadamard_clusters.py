"""Centroid clustering with a progressive search over exact Walsh-Hadamard coefficients.

Components become integers, and vectors and centroids are transformed once by the unscaled
Walsh-Hadamard transform: integers stay integers, and the squared distance of two vectors is
a 64th of that of their coefficients. Coefficients are ordered by their number of sign
changes, so the first few tell most, and the search adds up squared differences from coarse
to fine. What a centroid has so far never shrinks, so one that has more than the whole
distance of a known centroid is strictly worse and is left out; ties stay. What is left is
finished with all coefficients, and the smallest number among the nearest wins: the answer
is that of comparing with every centroid.

The transform is linear: a task adds up the coefficients of its vectors by cluster, Spark adds
up one row per task and cluster, and the inverse transform of the sums gives the centroids'
exact floor(sum / count) in the driver, which holds centroids and sums only. Every round reads
the written coefficients, so a lost executor costs its tasks.

Defined results: a null vector, one of another length, and one with a null, NaN or infinite
component is left out; a null id never starts a centroid but is assigned; rows that repeat an
id are vectors of their own (ties of the start are settled by the components); with fewer
vectors than centroids there are as many centroids as vectors, and an empty table gives an empty one; other
columns are not looked at. A component whose integer is beyond +-2**24 (16,384 times the
scale) is an error that says so, since 64 squares of such differences leave 64 bits.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import stored

#: Components of a vector; a power of two, as the transform needs.
SIZE = 64
#: Largest integer of a component whose squared distances fit into 64 bits in coefficients.
LARGEST = 1 << 24
#: Coefficients looked at after each step of the search.
LEVELS = (1, 2, 4, 8, 16, 32, SIZE)
#: Vectors searched at a time.
ROWS = 4096


def transform(vectors):
    """Unscaled Walsh-Hadamard coefficients of integer rows, by growing number of sign changes."""
    import numpy as np

    size = vectors.shape[1]
    out = vectors.astype(np.int64)
    half = 1
    while half < size:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(out), size)
        half *= 2
    return out[:, order(size)]


def order(size: int = SIZE):
    """Where the coefficient with 0, 1, 2, ... sign changes stands in the natural order of the transform."""
    bits = size.bit_length() - 1
    return [int(format(i ^ (i >> 1), f"0{bits}b")[::-1], 2) for i in range(size)]


def inverse(coefficients: list[int]) -> list[int]:
    """The exact integers whose transform this is, of Python's unbounded integers."""
    size = len(coefficients)
    out = [0] * size
    for place, value in zip(order(size), coefficients, strict=True):
        out[place] = value
    half = 1
    while half < size:
        for begin in range(0, size, 2 * half):
            for i in range(begin, begin + half):
                out[i], out[i + half] = out[i] + out[i + half], out[i] - out[i + half]
        half *= 2
    return [value // size for value in out]


def search(coefficients, centroids):
    """``(nearest, 64 * distance, compared)``: the smallest number of a nearest centroid for every row.

    ``compared`` counts the squared differences taken, of rows x centroids x coefficients.
    """
    import numpy as np

    n, k = len(coefficients), len(centroids)
    rows = np.repeat(np.arange(n), k)
    at = np.tile(np.arange(k), n)
    partial = np.zeros(n * k, np.int64)
    begin = compared = 0
    bound, bounding = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    for end in LEVELS:
        apart = coefficients[rows, begin:end] - centroids[at, begin:end]
        partial += (apart * apart).sum(1)
        compared += apart.size
        if end == SIZE:
            break
        begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        least = np.minimum.reduceat(partial, begins)
        # the whole distance of a centroid that leads so far bounds the nearest one's
        leads = np.flatnonzero(partial == np.repeat(least, np.diff(np.r_[begins, len(rows)])))
        leads = leads[np.r_[True, rows[leads[1:]] != rows[leads[:-1]]]]
        if end <= 4:
            leads = leads[bounding[rows[leads]] != at[leads]]
            bounding[rows[leads]] = at[leads]
            rest = coefficients[rows[leads], end:] - centroids[at[leads], end:]
            bound[rows[leads]] = np.minimum(bound[rows[leads]], partial[leads] + (rest * rest).sum(1))
            compared += rest.size
        alive = partial <= bound[rows]
        rows, at, partial = rows[alive], at[alive], partial[alive]
        begin = end
    begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    least = np.minimum.reduceat(partial, begins)
    wins = np.flatnonzero(partial == np.repeat(least, np.diff(np.r_[begins, len(rows)])))
    wins = wins[np.r_[True, rows[wins[1:]] != rows[wins[:-1]]]]
    return at[wins], partial[wins], compared


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; beyond the range that distances need, an error."""
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    inside = F.forall(vector, lambda x: F.abs(F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")) <= LARGEST)
    return F.when(inside, scaled).otherwise(F.raise_error(F.lit(f"a component's integer is beyond +-{LARGEST}")).cast("array<bigint>"))


def usable(vector: Column) -> Column:
    """Exactly ``SIZE`` components, none null or non-finite."""
    infinite = F.lit(float("inf"))
    return F.coalesce((F.size(vector) == SIZE) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite)), F.lit(False))


def _batches(batches):
    """``(record batch, coefficients)`` of at most ``ROWS`` rows."""
    import numpy as np

    for read in batches:
        for begin in range(0, read.num_rows, ROWS):
            part = read.slice(begin, ROWS)
            yield part, np.frombuffer(b"".join(part.column(1).to_pylist()), np.int32).reshape(-1, SIZE).astype(np.int64)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id_col, coefficients``: the usable vectors' coefficients as 64 four-byte integers, written once."""
    chosen = vectors.where(usable(F.col(vector_col))).select(F.col(id_col), integers(F.col(vector_col), scale).alias("vector"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for read in batches:
            raw = read.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            made = transform(raw).astype(np.int32)
            yield pa.RecordBatch.from_arrays([read.column(0), pa.array([row.tobytes() for row in made], pa.binary())], [id_col, "coefficients"])

    return stored(chosen.mapInArrow(run, T.StructType([chosen.schema[0], T.StructField("coefficients", T.BinaryType())])), "coefficients")


def first_centroids(vectors: DataFrame, id_col: str, vector_col: str, scale: int, centroids: int, seed: int) -> list[list[int]]:
    """The integer vectors whose id has the smallest SHA-256 of ``seed:id``."""
    named = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    hashed = named.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).alias("hash"), integers(F.col(vector_col), scale).alias("vector"))
    return [list(r.vector) for r in hashed.orderBy("hash", "vector").limit(centroids).collect()]


def _sums(coefficients: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """``{cluster: (count, sum of coefficients)}`` of the vectors nearest to each centroid."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = transform(np.array(centroids))
        counts, sums = np.zeros(len(own), np.int64), np.zeros((len(own), SIZE), np.int64)
        for _, read in _batches(batches):
            nearest, _, _ = search(read, own)
            counts += np.bincount(nearest, minlength=len(own))
            for j in np.unique(nearest):
                sums[j] += read[nearest == j].sum(0)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at]), *(pa.array(sums[at, c]) for c in range(SIZE))], names)

    names = ["cluster", "n", *(f"c{c}" for c in range(SIZE))]
    parts = coefficients.mapInArrow(run, ", ".join(["cluster int", *(f"{n} long" for n in names[1:])]))
    # a task's sums fit into 64 bits, those of all tasks need not
    total = parts.groupBy("cluster").agg(*(F.sum(F.col(n).cast("decimal(20,0)")).alias(n) for n in names[1:]))
    return {r.cluster: (int(r.n), [int(v) for v in r[2:]]) for r in total.collect()}


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, centroids: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector.

    A round that moves no centroid is the last, as all further ones would repeat it.
    """
    made = prepared(vectors, id_col, vector_col, scale)
    now = first_centroids(vectors, id_col, vector_col, scale, centroids, seed)
    for _ in range(rounds if now else 0):
        moved = [list(c) for c in now]
        for j, (count, sums) in _sums(made, now).items():
            moved[j] = [value // count for value in inverse(sums)]
        if moved == now:
            break
        now = moved

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = transform(np.array(now))
        for part, read in _batches(batches):
            nearest, distance, _ = search(read, own)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nearest, pa.int32()), pa.array(distance // SIZE, pa.int64())], [id_col, "cluster", "distance"])

    schema = T.StructType([made.schema[0], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not now:  # no vector, or none with an id
        empty = made.where(F.lit(False)).select(id_col, *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
        return empty
    assigned = stored(made.mapInArrow(run, schema), "assigned")
    inertia = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    of_cluster = F.element_at(F.array(*(F.lit(inertia.get(j, 0)).cast("long") for j in range(len(now)))), F.col("cluster") + 1)
    digest = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1)
    return assigned.select(id_col, "cluster", "distance", of_cluster.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), digest.alias("centroid_sha256"))


def sql(centroids: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> str:
    """DuckDB SQL for the same rows of ``embeddings``: every centroid compared in every round."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {SIZE})",
        f"parts AS MATERIALIZED (SELECT rid, unnest(range({SIZE})) AS p, CAST(unnest(list_transform(embedding, lambda x: floor({scale} * x::DOUBLE))) AS BIGINT) AS v FROM kept)",
        f"starts AS (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {centroids})",
        "c0 AS MATERIALIZED (SELECT c, p, v FROM starts JOIN parts USING (rid))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT rid, min_by(c, d * 1000 + c) AS c, min(d) AS d FROM (SELECT rid, c, sum((parts.v - c{i}.v) * (parts.v - c{i}.v)) AS d FROM parts JOIN c{i} USING (p) GROUP BY rid, c) GROUP BY rid)")
        if i < rounds:
            moved = "CASE WHEN s % n < 0 THEN (s - s % n) // n - 1 ELSE (s - s % n) // n END"
            steps.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c, p, coalesce({moved}, old.v)::BIGINT AS v FROM c{i} old LEFT JOIN (SELECT c, p, sum(v) AS s, count(*) AS n FROM a{i} JOIN parts USING (rid) GROUP BY c, p) USING (c, p))"
            )
    steps.append(f"named AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN kept USING (rid) JOIN named USING (c)
    """
