"""SimHash near-duplicates over an inverted index of byte positions, with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most ``k`` bits
(``k`` < 8) share at least ``8 - k`` of them, the guaranteed minimum. A posting list of one
positional byte holds a 256th of all fingerprints, far too many to tally pair by pair; the
lists are therefore kept for every choice of ``8 - k`` positions, and a pair that meets in
such a list has reached the minimum. The tally of its shared positional bytes then tells in
which of its lists it is handled (the first one), and its bit distance is verified.

Only distinct fingerprints are indexed, so copies cost nothing. A list is read from a sorted
stream; of its verified links a spanning forest goes on, which leaves components unchanged.
Lists are counted first; one of over ``BLOCK`` fingerprints is cut into blocks by a hash before it
is dealt out, in pairs of blocks, so that no task holds it whole.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import stored

#: Fingerprints of one posting list that are compared in one go.
BLOCK = 4096
#: Shingles whose hashes are unpacked to bits at once.
UNPACKED = 1 << 16


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of a text; 0 for a text without words."""
    import numpy as np
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not found:
        return 0
    joined = b" ".join(found)
    starts, at = [], 0
    for word in found:
        starts.append(at)
        at += len(word) + 1
    digest = xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1)
    ends = [s - 1 for s in starts[words:]] + [len(joined)]
    counts = np.zeros(64, np.int64)
    for i in range(0, n, UNPACKED):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[i : min(n, i + UNPACKED)], ends[i : i + UNPACKED], strict=False)], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``id_col, fp`` for each row; ``fp`` holds the 64 bits as a signed long. A null text counts as empty."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            prints = np.array([fingerprint(text.as_py(), words) for text in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], [id_col, "fp"])

    return source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("fp", T.LongType())]))


def _first_lists(shared: int) -> list[int]:
    """For each set of equal positions (as a bit mask) the first choice of ``shared`` of them, else -1."""
    choices = list(combinations(range(8), shared))
    return [next((i for i, c in enumerate(choices) if all(mask >> p & 1 for p in c)), -1) for mask in range(256)]


def _forest(left, right, choice: int, bits: int, first, same: bool):
    """Links that join what is not joined yet, among pairs of two blocks handled in this list."""
    import numpy as np

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for i, one in enumerate(left):
        other = right[i + 1 :] if same else right
        difference = other ^ one
        near = other[np.bitwise_count(difference) <= bits]
        if len(near):
            equal = ((near ^ one)[:, None] >> np.arange(0, 64, 8, dtype=np.uint64) & np.uint64(255)) == 0
            tally = (equal * (1 << np.arange(8))).sum(1)
            for x in near[first[tally] == choice].tolist():
                a, b = root(int(one)), root(x)
                if a != b:
                    parent[a] = b
                    links.append((int(one), x))
    return links


def links(prints: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """``a, b``: links of distinct fingerprints ``fp`` that keep every component of distance ``bits`` together."""
    if not 0 <= bits < 8:
        raise ValueError("a shared positional byte is guaranteed only for 0 to 7 differing bits")
    shared = 8 - bits
    choices = list(combinations(range(8), shared))
    keys = [
        F.struct(F.lit(i).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(sum(255 << 8 * p for p in c)))).alias("bytes"))
        for i, c in enumerate(choices)
    ]
    postings = prints.select("fp", F.explode(F.array(*keys)).alias("list")).select("list.choice", "list.bytes", "fp")
    dealt = dealt_lists(postings, block)
    first = _first_lists(shared)

    def find(batches):
        import numpy as np

        own = np.array(first)

        def take(group) -> list[tuple[int, int]]:
            """The links of a whole list or block, or of a pair of blocks."""
            choice, _, _, upper, fp = group
            fp, whole = fp.view(np.uint64), not upper.any()
            left, right = (fp, fp) if whole else (fp[~upper], fp[upper])
            return _forest(left, right, int(choice[0]), bits, own, whole)

        held = None
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            if not len(columns[4]):
                continue
            changed = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
            starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            held = [c[starts[-1] :] for c in columns]
            found = []
            for k in np.flatnonzero(np.diff(starts) > 1):
                found += take([c[starts[k] : starts[k + 1]] for c in columns])
            if found:
                yield links_of(found)
        if held is not None and len(held[4]) > 1:
            yield links_of(take(held))

    def links_of(pairs):
        import numpy as np
        import pyarrow as pa

        pairs = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(find, "a long, b long").distinct()


def dealt_lists(postings: DataFrame, block: int) -> DataFrame:
    """``choice, bytes, pair, upper, fp``: sorted lists; one of over ``block`` fingerprints as pairs of blocks.

    The fingerprints of a long list are dealt to blocks by their hash and go once to every pair
    their block is in, ``upper`` in the second place; no group is of much over two blocks.
    """
    sizes = postings.groupBy("choice", "bytes").agg(F.count("*").alias("n")).where(F.col("n") > block)
    long_lists = stored(sizes.select("choice", "bytes", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "long-lists")
    salted = postings.join(long_lists, ["choice", "bytes"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    salted = salted.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    met = salted.select("choice", "bytes", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.shiftleft(F.least("own", "other").cast("long"), 32) + F.greatest("own", "other")
    rows = met.select("choice", "bytes", pair.alias("pair"), (F.col("own") > F.col("other")).alias("upper"), "fp")
    return rows.repartition("choice", "bytes", "pair").sortWithinPartitions("choice", "bytes", "pair")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """``id_col, fingerprint, component_id``: the smallest id reachable over links of at most ``bits`` bits.

    Defined results: null and blank texts have the fingerprint zero, which links like any
    other; a null id is never the smallest, and a component of null ids only has a null
    ``component_id``; repeated rows come back as often as they came; other columns of the
    input are not looked at; an empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    firsts = stored(prints.groupBy("fp").agg(F.min(id_col).alias("smallest")), "distinct-fingerprints")
    roots = stored(components(links(firsts.select("fp"), bits)), "roots")
    smallest = roots.join(firsts, roots.node == firsts.fp).groupBy("root").agg(F.min("smallest").alias("component_id"))
    joined = roots.join(smallest, "root").select("node", "component_id")
    linked = firsts.join(joined, firsts.fp == joined.node, "left")
    classes = stored(linked.select("fp", F.coalesce("component_id", "smallest").alias("component_id")), "classes")
    return prints.join(classes, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
