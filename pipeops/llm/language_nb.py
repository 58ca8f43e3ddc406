"""The language of a text by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and read as words of letters and marks, each with one blank on either
side; its n-grams of one to ``ORDERS`` characters lie within such a word, blanks included,
and are hashed into ``BUCKETS``. Learning adds up, in every task, how often a language has
each bucket; only these sums are shuffled, and languages x buckets numbers come to the
driver, whatever the corpus holds. The log-probabilities are one matrix, broadcast; a batch
of texts is a sparse matrix of bucket counts whose product with it is taken in numpy.

``MATRIX_BYTES`` is checked before sums are collected and before the matrix is broadcast:
more languages than fit are an error that names the bound, never a smaller model.

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0, as
is every text where nothing was learned; such texts are not learned from, nor are rows with
a null language or a null id (whose fold is not known; they count as not held out). A text
of any length is worked on in slices that end between words (a run of letters longer than
``SLICE`` is cut as if a word ended). Equal scores go to the language first in text order;
repeated rows are learned and answered as often as they come; an empty table gives an empty
one; other columns of the input are not looked at.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import stored

#: Longest n-gram, and into how many buckets n-grams are hashed (a power of two).
ORDERS, BUCKETS = 4, 1 << 16
#: Characters worked on at a time.
SLICE = 1 << 19
#: What the log-probabilities of all languages may take, in the driver and in every executor.
MATRIX_BYTES = 128 << 20
#: Languages whose sums a task holds before it passes them on.
HELD = 32
#: The answer for a text that shows no language.
UNKNOWN = "und"


@lru_cache(maxsize=1)
def kinds():
    """For every code point: 2 for a letter, 1 for a mark, 0 for anything else."""
    import numpy as np

    first = {"L": 2, "M": 1}
    return np.fromiter((first.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def pieces(text: str):
    """The lower-cased text in slices of at most ``SLICE`` characters that end at a blank, if there is one."""
    text = text.lower()
    start = 0
    while len(text) - start > SLICE:
        cut = max(text.rfind(blank, start, start + SLICE) for blank in (" ", "\n"))
        end = cut + 1 if cut > start else start + SLICE
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def groups(texts):
    """``(slices, owners)``: slices of texts, and the number of the text each is from, about ``SLICE`` characters at a time."""
    slices, owners, size = [], [], 0
    for owner, text in enumerate(texts):
        for piece in pieces(text):
            if slices and size + len(piece) > SLICE:
                yield slices, owners
                slices, owners, size = [], [], 0
            slices.append(piece)
            owners.append(owner)
            size += len(piece) + 2
    if slices:
        yield slices, owners


def grams(slices: list[str], orders: int = ORDERS, buckets: int = BUCKETS):
    """``(letters, found)``: for each slice whether it has a letter, and a list of ``(slice, bucket)`` arrays, one per order."""
    import numpy as np

    code = np.frombuffer("".join(f"\0{s}\0" for s in slices).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(s) + 2 for s in slices), np.int64, len(slices))
    row = np.repeat(np.arange(len(slices), dtype=np.int32), sizes)
    kind = kinds()[code]
    letters = np.bincount(row[kind == 2], minlength=len(slices)) > 0
    inside = kind > 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[np.r_[0, np.cumsum(sizes)[:-1]]] = True
    sign = np.where(inside, code, 32).astype(np.uint32)[keep]
    row = row[keep]
    blank = sign == 32
    found = []
    mixed, valid = sign.copy(), ~blank
    for n in range(1, orders + 1):
        if n > 1:
            mixed = mixed[:-1] * np.uint32(0x01000193) + sign[n - 1 :]
            if n == 2:
                valid = row[:-1] == row[1:]
            else:
                valid = valid[:-1] & (row[n - 1 :] == row[: 1 - n]) & ~blank[n - 2 : -1]
        spread = (mixed ^ np.uint32(0x9E3779B9 * n & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        spread = (spread ^ (spread >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        found.append((row[: len(valid)][valid], (spread[valid] >> np.uint32(16)).astype(np.int64) % buckets))
    return letters, found


@dataclass
class Bayes:
    """Languages in text order, their log priors, and the log-probability of each bucket in each language."""

    languages: list[str]
    priors: object
    matrix: object

    def scores(self, texts: list[str]):
        """``(answer, score)`` of each text: a number of a language or -1, and its posterior probability."""
        import numpy as np

        totals = np.tile(self.priors, (len(texts), 1)) if self.languages else np.zeros((len(texts), 0))
        lettered = np.zeros(len(texts), bool)
        for slices, owners in groups(texts):
            letters, found = grams(slices, buckets=self.matrix.shape[1])
            owner = np.array(owners)
            lettered[owner[letters]] = True
            for row, bucket in found:
                for j in range(len(self.languages)):
                    np.add.at(totals[:, j], owner, np.bincount(row, self.matrix[j][bucket], len(slices)))
        if not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts))
        best = totals.argmax(1)
        top = totals[np.arange(len(texts)), best]
        share = 1 / np.exp(totals - top[:, None]).sum(1)
        return np.where(lettered, best, -1), np.where(lettered, share, 0.0)


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether the checksum of the id as text falls in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def bucket_sums(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, bucket, n`` over all rows outside the held-out fold; bucket -1 counts the texts."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    source = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict = {}

        def passed_on():
            for lang, (texts, counts) in held.items():
                at = np.flatnonzero(counts)
                columns = [pa.repeat(lang, len(at) + 1), pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[texts, counts[at]], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])
            held.clear()

        for read in batches:
            langs, texts = read.column(0).to_pylist(), [t or "" for t in read.column(1).to_pylist()]
            names = sorted(set(langs))
            if len(held) > HELD:
                yield from passed_on()
            number = {name: j for j, name in enumerate(names)}
            of = np.array([number[name] for name in langs])
            for name in names:
                held.setdefault(name, [0, np.zeros(BUCKETS, np.int64)])
            lettered = np.zeros(len(texts), bool)
            for slices, owners in groups(texts):
                letters, found = grams(slices)
                owner = np.array(owners)
                lettered[owner[letters]] = True
                lang = of[owner]
                for row, bucket in found:
                    for j in np.unique(lang[np.unique(row)]):
                        held[names[j]][1] += np.bincount(bucket[lang[row] == j], minlength=BUCKETS)
            for j, n in enumerate(np.bincount(of[lettered], minlength=len(names))):
                held[names[j]][0] += int(n)
        yield from passed_on()

    return source.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, *, smoothing: float = 0.5, matrix_bytes: int = MATRIX_BYTES, **columns) -> Bayes:
    """A model of all languages with a text outside the held-out fold, from all such texts."""
    import numpy as np

    sums = stored(bucket_sums(docs, **columns), "bucket-sums")
    texts = sums.where("bucket = -1 AND n > 0")
    count = texts.count()
    if count * BUCKETS * 8 > matrix_bytes:
        raise ValueError(f"{count} languages need a matrix of {count * BUCKETS * 8} bytes; matrix_bytes allows {matrix_bytes}")
    known = {r.lang: r.n for r in texts.collect()}
    languages = sorted(known)
    number = {name: j for j, name in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    for batch in sums.where("bucket >= 0").toArrow().to_batches():
        for name, bucket, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name in number:
                counts[number[name], bucket] = n
    smoothed = counts + smoothing
    priors = np.array([known[name] for name in languages], float)
    matrix = np.log(smoothed) - np.log(smoothed.sum(1, keepdims=True)) if languages else smoothed
    return Bayes(languages, np.log(priors / priors.sum()) if languages else priors, matrix)


def predict(docs: DataFrame, model: Bayes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of every row."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        own = sent.value
        for read in batches:
            best, score = own.scores([t or "" for t in read.column(1).to_pylist()])
            names = pa.array([own.languages[j] if j >= 0 else UNKNOWN for j in best], pa.string())
            yield pa.RecordBatch.from_arrays([read.column(0), names, pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return source.mapInArrow(run, T.StructType([source.schema[0], *fields]))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``id_col, held_out, lang_pred, score``: learned from the rows outside the held-out fold."""
    model = learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    predicted = predict(docs, model, id_col=id_col, text_col=text_col)
    return predicted.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
