"""Runs of repeated words (maximal periodic stretches) by string synchronising sets.

A run is a stretch of consecutive words whose smallest period q (words q apart are identical)
fits into it at least twice and which no neighbouring word extends keeping period q.

At every dyadic scale t, a place s is *synchronising* if the least hash among the t-word
contexts that start at s .. s + t stands at one of the two ends. The choice looks at the 2t
words from s alone, so equal passages choose the same places, about 2 in t + 1 of all.
Contexts inside a highly periodic region (period at most t / 3) do not take part; a window
of t places holds no synchronising one only if its words are such a region. Hence, of a run
with period 3t - 1 .. 6t - 2,

* either a synchronising place lies in its first part, and the same context stands one period
  later: every pair of synchronising places with equal context and such a distance proposes
  its distance as a period, which is verified word by word in both directions;
* or a whole period of it is highly periodic, at either side of a break between two regions
  with the same repeated words out of step: all periods that such a pair of regions permits
  follow from their ends. Runs of period 1 are read off equal neighbours.

Highly periodic regions at scale t are the runs already found with periods up to t / 3, so
scales go from fine to coarse. Contexts are compared by 64-bit hashes, which only propose:
equal contexts always have equal hashes, and what is reported is compared word by word.

Many documents are worked on at once, one after the other in one array, with a word of its
own after each, which can be in no run; the longest come first, so a coarse scale reads only the
documents that can hold its periods. Memory is about 100 bytes a word of such a group
(``GROUP_WORDS``, or the longest document).

Defined results: a null text has no words, and neither has an empty one; a null id has no
checksum, so its words are left as they are; repeated rows are answered as often as they
come; equal lengths are settled by start, then period; an empty table gives an empty one;
other columns are not looked at. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words worked on together.
GROUP_WORDS = 1 << 18
#: Shortest run that is reported, in words.
LEAST_LENGTH = 12


def _mixed(x):
    """Spreads 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _agree(words, left: int, right: int, most: int) -> int:
    """How many words from ``left`` on equal those from ``right`` on, up to ``most``."""
    import numpy as np

    done, step = 0, 32
    while done < most:
        step = min(step, most - done)
        differ = words[left + done : left + done + step] != words[right + done : right + done + step]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += step
        step = min(4 * step, 1 << 16)
    return most


def _agree_back(words, left: int, right: int) -> int:
    """How many words before ``left`` equal those before ``right``."""
    done, step = 0, 32
    while done < left:
        step = min(step, left - done)
        differ = (words[left - done - step : left - done] != words[right - done - step : right - done])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += step
        step = min(4 * step, 1 << 16)
    return left


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def _primitive(words, start: int, period: int) -> bool:
    """Whether no divisor of the period is a period of the run that starts there."""
    return not any((words[start : start + period] == words[start + period // p : start + period + period // p]).all() for p in _primes(period))


def _verified(words, places, periods, found: set) -> None:
    """Adds the runs ``(start, end, period)`` that the proposals ``words[place] = words[place + period]`` belong to."""
    import numpy as np

    if not len(places):
        return
    order = np.lexsort((places, periods))
    places, periods = places[order], periods[order]
    cuts = np.flatnonzero(np.r_[True, periods[1:] != periods[:-1], True])
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        period, at = int(periods[begin]), begin
        while at < end:
            place = int(places[at])
            ahead = _agree(words, place, place + period, len(words) - place - period)
            if ahead:
                start = place - _agree_back(words, place, place + period)
                if place + ahead - start >= period and _primitive(words, start, period):
                    found.add((start, place + ahead + period, period))
                # every proposal inside the stretch is settled
                at = max(at + 1, begin + int(np.searchsorted(places[begin:end], place + ahead)))
            else:
                at += 1


def _window_least(values, width: int):
    """The least of each ``width`` consecutive values."""
    import numpy as np

    least, have = values, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def _periodic(found, scale: int, size: int):
    """Which places start a context of ``scale`` words that is highly periodic."""
    import numpy as np

    edges = np.zeros(size + 1, np.int64)
    for start, end, period in found:
        if 3 * period <= scale <= end - start and start < size:
            edges[start] += 1
            edges[min(size, end - scale + 1)] -= 1
    return np.cumsum(edges[:size]) > 0


def synchronising(hashes, scale: int, periodic):
    """The synchronising places, given the hash of each place's context of ``scale`` words."""
    import numpy as np

    never = np.uint64(0xFFFFFFFFFFFFFFFF)
    taken = np.where(periodic, never, hashes >> np.uint64(1))
    if len(taken) <= scale:
        return np.zeros(0, np.int64)
    least = _window_least(taken, scale + 1)
    return np.flatnonzero((least != never) & ((taken[: len(least)] == least) | (taken[scale:] == least)))


def _pairs(contexts, places, nearest: int, farthest: int):
    """All ``(place, distance)`` of two places with equal contexts at a distance within the bounds."""
    import numpy as np

    order = np.argsort(contexts, kind="stable")
    contexts, places = contexts[order], places[order]
    out = [np.zeros((2, 0), np.int64)]
    apart = 1
    while apart < len(places):
        near = (contexts[apart:] == contexts[:-apart]) & (places[apart:] - places[:-apart] <= farthest)
        if not near.any():
            break
        at = np.flatnonzero(near)
        distance = places[at + apart] - places[at]
        out.append(np.stack([places[at], distance])[:, distance >= nearest])
        apart += 1
    return np.concatenate(out, 1)


def _broken(words, found: set, scale: int) -> set:
    """Runs with periods 3 * scale - 1 .. 6 * scale - 2 around the break between two highly periodic regions."""
    regions: dict[int, list] = {}
    for start, end, period in found:
        if 3 * period <= scale and end - start >= 3 * scale - 1:
            regions.setdefault(period, []).append((start, end))
    made = set()
    for period, listed in regions.items():
        listed.sort()
        for (s1, e1), (s2, e2) in zip(listed, listed[1:], strict=False):
            if s2 > e1:
                continue
            # by how much the second region's words are turned against the first's
            unit = words[s1 : s1 + period].tolist()
            twice = unit + unit
            other = words[s2 : s2 + period].tolist()
            turn = next((c for c in range(period) if twice[c] == other[0] and twice[c : c + period] == other), None)
            if turn is None:
                continue
            least = 3 * scale - 1
            first = least + (s2 - s1 - turn - least) % period
            for q in range(first, min(6 * scale - 2, e1 - s1, e2 - s2) + 1, period):
                start, stop = max(s1, s2 - q), min(e1, e2 - q)
                if s1 == s2 - q:
                    start -= _agree_back(words, start, start + q)
                if e1 == e2 - q:
                    stop += _agree(words, stop, stop + q, len(words) - stop - q)
                if stop - start >= q:
                    made.add((start, stop + q, q))
    return made


def runs_of(documents: list) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of every run of each document (arrays of word numbers), by start, then period.

    All runs that hold their period twice, whatever their length.
    """
    import numpy as np

    longest_first = sorted(range(len(documents)), key=lambda d: -len(documents[d]))
    sizes = np.array([len(documents[d]) for d in longest_first], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    words = np.full(int((sizes + 1).sum()), -1, np.int64)
    for begin, d in zip(begins.tolist(), longest_first, strict=True):
        words[begin : begin + len(documents[d])] = documents[d]
    ends = begins + sizes
    words[ends] = -1 - np.arange(len(ends))
    found: set = set()
    # period 1: equal neighbours
    same = np.r_[False, words[1:] == words[:-1], False]
    turns = np.flatnonzero(same[1:] != same[:-1])
    found.update((int(a), int(b) + 1, 1) for a, b in zip(turns[::2], turns[1::2], strict=True))
    hashes = _mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    scale = 1
    while True:
        fitting = int((sizes >= 6 * scale - 2).sum())
        if not fitting:
            break
        size = int(ends[fitting - 1]) + 1
        words, hashes = words[:size], hashes[:size]
        contexts = _mixed(hashes[:-scale] * np.uint64(0xD6E8FEB86659FD93) + hashes[scale:])
        known = [r for r in found if 3 * r[2] <= scale]
        places = synchronising(hashes, scale, _periodic(known, scale, len(hashes)))
        places = places[places < len(contexts)]
        proposed = _pairs(contexts[places], places, 3 * scale - 1, 6 * scale - 2)
        broken = _broken(words, known, scale)
        _verified(words, proposed[0], proposed[1], found)
        found |= broken
        hashes = contexts
        scale *= 2
    out: list[list] = [[] for _ in documents]
    listed = sorted(found)
    where = np.searchsorted(begins, [r[0] for r in listed], side="right") - 1 if listed else []
    for (start, end, period), at in zip(listed, where, strict=True):
        out[longest_first[at]].append((start - int(begins[at]), end - start, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def repeated(n: int, checksum: int | None):
    """Which original word stands at each place: every tenth checksum makes a document periodic from some word on."""
    import numpy as np

    at = np.arange(n)
    if checksum is None or checksum % 10 or not n:
        return at
    g = checksum // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


def report(words: list[bytes], runs: list[tuple[int, int, int]], least: int = LEAST_LENGTH) -> tuple:
    """The result columns of one document from its words and all its runs."""
    import numpy as np

    runs = [r for r in runs if r[1] >= least]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shape = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = words
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        starts, lengths, periods = np.array(runs).T
        np.add.at(edges, starts + periods, 1)
        np.add.at(edges, starts + lengths, -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
    return (len(runs), *shape, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, plant: bool = False) -> DataFrame:
    """``id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` of every document.

    ``plant`` first makes every document whose id has a checksum divisible by ten periodic, as :func:`repeated` says.
    """
    # as bytes, so that words are what ASCII white space leaves
    source = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"), F.crc32(F.col(id_col).cast("string")).alias("checksum"))
    kinds = [("n_runs", T.LongType()), *((n, T.LongType()) for n in ("start", "length", "period", "exponent_milli")), ("runs_sha256", T.StringType()), ("collapsed_sha256", T.StringType())]
    schema = T.StructType([source.schema[0], *(T.StructField(n, t) for n, t in kinds)])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def done(keys, group):
            numbers: dict[bytes, int] = {}
            listed = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in group]
            rows = [report(words, runs, least) for words, runs in zip(group, runs_of(listed), strict=True)]
            columns = [pa.array(c, pa.int64() if t == T.LongType() else pa.string()) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([keys, *columns], schema.names)

        for read in batches:
            begun, group, size = 0, [], 0
            for text, checksum in zip(read.column(1), read.column(2), strict=True):
                words = (text.as_py() or b"").split()
                if plant and checksum.as_py() is not None and checksum.as_py() % 10 == 0:
                    words = [words[i] for i in repeated(len(words), checksum.as_py()).tolist()]
                if group and size + len(words) > GROUP_WORDS:
                    yield done(read.column(0).slice(begun, len(group)), group)
                    begun, group, size = begun + len(group), [], 0
                group.append(words)
                size += len(words)
            if group:
                yield done(read.column(0).slice(begun, len(group)), group)

    return source.mapInArrow(run, schema)
