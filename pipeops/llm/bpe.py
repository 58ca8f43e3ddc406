"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A rank file gives the vocabulary: the bytes of a token and its id. Bytes are written as
printable characters (the byte table of byte-level BPE) for the library, which then merges
each match of the splitting pattern on its own. Matches repeat a lot, so a worker keeps the
ids of those it has met in a table of bounded size; the rest go to the library in one batch.

Both operators are row-local: no shuffle, one Arrow batch in memory at a time, and texts
longer than ``SLICE`` are cut where a match must end (a blank after a non-blank).

Defined results: a null text counts as empty and gives an empty id list; null ids stay null;
repeated rows are encoded each for itself; other columns of the input are not looked at; an
empty table gives an empty one; a very long text is encoded in slices. Decoding null or
unknown ids gives null.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of a text that are split into matches at once.
SLICE = 1 << 18
#: Matches whose ids a worker remembers.
REMEMBERED = 200_000
#: Tokens in an output batch.
BATCH_TOKENS = 1 << 19


def byte_table() -> dict[int, str]:
    """The character that stands for each byte: itself if printable in Latin-1, else one from 256 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    """Bytes of each token and its id; a bare name is looked up among the public tokenizers."""
    if os.sep not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """A vocabulary as the library's model, with what a worker remembers."""

    def __init__(self, vocabulary: str, pattern: str | None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        ranks = read_ranks(vocabulary)
        shown = byte_table()
        as_text = {token: "".join(shown[b] for b in token) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
            pairs = [p for p in cuts if p[0] in ranks and p[1] in ranks]
            pairs.sort(key=lambda p: (ranks[p[0]], ranks[p[1]]))
            merges += [(as_text[a], as_text[b]) for a, b in pairs]
        model = models.BPE(vocab={as_text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        # the pattern is applied here, so that equal matches are merged once
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.matches = regex.compile(pattern).findall
        unseen = {character: byte for byte, character in shown.items()}
        self.bytes_of = {
            rank: bytes(unseen[c] for c in self.tokenizer.id_to_token(rank)) for rank in ranks.values()
        }
        self.lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for rank, token in self.bytes_of.items():
            self.lengths[rank] = len(token)
        self.known: dict[str, bytes] = {}  # int32 ids

    def encode_all(self, texts: list[str]) -> list:
        """The ids of each text, as int32 arrays; matches not met before are merged in one call."""
        import numpy as np

        found = [self.matches(text) for text in texts]
        new = list(set(chain.from_iterable(found)).difference(self.known))
        if new:
            encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self.known.update(zip(new, [np.array(e.ids, np.int32).tobytes() for e in encoded], strict=True))
        ids_of = self.known.__getitem__
        ids = [np.frombuffer(b"".join(map(ids_of, matches)), np.int32) for matches in found]
        if len(self.known) > REMEMBERED:
            for match in new:
                del self.known[match]
        return ids

    def encode(self, text: str):
        import numpy as np

        return np.concatenate([self.encode_all([part])[0] for part in slices(text)])

    def offsets(self, ids, raw: bytes):
        """Code points where each token starts and ends, and how many tokens start inside a character."""
        import numpy as np

        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        character = np.cumsum(first) - 1
        return character[starts], character[ends - 1] + 1, int((~first[starts]).sum())

    def decode(self, ids: list[int]) -> bytes | None:
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            return None


def slices(text: str) -> Iterator[str]:
    """Parts of the text, cut only before white space that follows something else.

    A match holds white space at its start or is white space altogether, so it cannot run
    over such a place; what is left of the cut does not depend on what is right of it.
    """
    start = 0
    while len(text) - start > SLICE:
        cut = re.compile(r"(?<=[^\s])[ \n]").search(text, start + SLICE)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def grouped(texts: Iterator[str]) -> Iterator[list[str]]:
    """Texts in groups of at most ``SLICE`` characters; a longer text is a group of its own."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > SLICE:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


@lru_cache(maxsize=4)
def codec(vocabulary: str, pattern: str | None) -> Codec:
    return Codec(vocabulary, pattern)


def encode(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    pattern: str | None = None,
    offsets: bool = False,
) -> DataFrame:
    """``id_col, ids, n_tokens, n_split``: the ids of each whole text.

    ``n_split`` counts tokens that begin inside a character. With ``offsets`` the arrays
    ``starts`` and ``ends`` give each token's code points; a token that holds a part of a
    character covers the whole of it.
    """
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("n_split", T.LongType())]
    if offsets:
        fields += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("starts", "ends")]
    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = codec(vocabulary, pattern)

        def listed(arrays):
            ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
            return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *arrays])))

        def batch(keys, rows):
            columns = [keys, listed([r[0] for r in rows]), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
            names = [id_col, "ids", "n_tokens", "n_split"]
            if offsets:
                columns += [listed([r[2] for r in rows]), listed([r[3] for r in rows])]
                names += ["starts", "ends"]
            return pa.RecordBatch.from_arrays(columns, names)

        def row(text, ids):
            starts, ends, split = own.offsets(ids, text.encode()) if len(ids) else (ids, ids, 0)
            return (ids, split, starts.astype(np.int32), ends.astype(np.int32)) if offsets else (ids, split)

        for read in batches:
            rows, begun, tokens = [], 0, 0
            for texts in grouped(text.as_py() or "" for text in read.column(1)):
                encoded = own.encode_all(texts) if len(texts) > 1 else [own.encode(texts[0])]
                rows += map(row, texts, encoded)
                tokens += sum(map(len, encoded))
                if tokens >= BATCH_TOKENS:
                    yield batch(read.column(0).slice(begun, len(rows)), rows)
                    rows, begun, tokens = [], begun + len(rows), 0
            if rows:
                yield batch(read.column(0).slice(begun, len(rows)), rows)

    return source.mapInArrow(run, T.StructType([source.schema[0], *fields]))


def splitter(pattern: str | None):
    """The function that gives a text's matches of the splitting pattern."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN if pattern is None else pattern).findall


@lru_cache(maxsize=4)
def merger(vocabulary: str, pattern: str | None):
    """The function that gives the ids of one match."""
    import public_tokenizers
    import tiktoken

    pattern = public_tokenizers.PATTERN if pattern is None else pattern
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=read_ranks(vocabulary), special_tokens={})._encode_single_piece


def count(docs: DataFrame, vocabularies: Sequence[str] = (VOCABULARY,), *, text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """The input without its text, with ``n_tokens``: for each vocabulary how many ids :func:`encode` gives.

    A text is split into matches once for all vocabularies, of which a worker remembers the
    numbers of ids only; new ones are merged by the tiktoken library, which takes single matches
    at less cost. A null text has none.
    """
    kept = [c for c in docs.columns if c not in (text_col, "n_tokens")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("text"))
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("n_tokens", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa

        matches_of, merge = splitter(pattern), [merger(vocabulary, pattern) for vocabulary in vocabularies]
        known: list[dict[str, int]] = [{} for _ in merge]

        def sizes(texts: list[str]) -> list[list[int]]:
            """Per text and vocabulary."""
            found = [matches_of(text) for text in texts]
            met = set(chain.from_iterable(found))
            out = []
            for merged, have in zip(merge, known, strict=True):
                new = list(met.difference(have))
                have.update(zip(new, map(len, map(merged, new)), strict=True))
                out.append([sum(map(have.__getitem__, matches)) for matches in found])
                if len(have) > REMEMBERED:
                    for match in new:
                        del have[match]
            return [list(row) for row in zip(*out, strict=True)]

        for read in batches:
            rows: list[list[int]] = []
            for texts in grouped(text.as_py() or "" for text in read.column(len(kept))):
                if len(texts) > 1:
                    rows += sizes(texts)
                else:
                    rows.append([sum(parts) for parts in zip(*(sizes([part])[0] for part in slices(texts[0])), strict=True)])
            yield pa.RecordBatch.from_arrays([*read.columns[: len(kept)], pa.array(rows, pa.list_(pa.int64()))], schema.names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, *, ids_col: str = "ids", pattern: str | None = None, as_text: bool = False) -> DataFrame:
    """The input without ``ids_col``, with ``decoded`` (the bytes) and, if asked for, ``decoded_text``.

    Bytes are joined before they are read as UTF-8, so characters split over tokens come
    back whole; bytes that are no UTF-8 become U+FFFD in ``decoded_text`` only.
    """
    kept = [c for c in encoded.columns if c != ids_col]
    source = encoded.select(*kept, ids_col)
    fields = [T.StructField("decoded", T.BinaryType())] + [T.StructField("decoded_text", T.StringType())] * as_text

    def run(batches):
        import pyarrow as pa

        own = codec(vocabulary, pattern)
        def batch(keys, done):
            columns = [*keys, pa.array(done, pa.binary())]
            if as_text:
                columns.append(pa.array([None if raw is None else raw.decode("utf-8", "replace") for raw in done], pa.string()))
            return pa.RecordBatch.from_arrays(columns, [*kept, "decoded", "decoded_text"][: len(columns)])

        for read in batches:
            done, begun, tokens = [], 0, 0
            keys = read.columns[: len(kept)]
            for ids in read.column(len(kept)):
                listed = None if not ids.is_valid else ids.values.to_numpy(zero_copy_only=False).tolist()
                done.append(None if listed is None else own.decode(listed))
                tokens += len(listed or ())
                if tokens >= BATCH_TOKENS:
                    yield batch([k.slice(begun, len(done)) for k in keys], done)
                    done, begun, tokens = [], begun + len(done), 0
            if done:
                yield batch([k.slice(begun, len(done)) for k in keys], done)

    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in kept), *fields]))


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_split`` of each whole text.

    Encodes and decodes as :func:`encode` and :func:`decode` do, a group of texts at a time
    in one worker: the ids are digested where they are made, so a core needs one Python
    process and not two, and id lists do not travel.
    """
    source = docs.select("doc_id", F.col("text").alias("text"))
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("n_split", T.LongType())]
    schema = T.StructType([source.schema[0], *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        import pyarrow as pa

        own = codec(vocabulary, None)
        for read in batches:
            rows = []
            for texts in grouped(text.as_py() or "" for text in read.column(1)):
                encoded = own.encode_all(texts) if len(texts) > 1 else [own.encode(texts[0])]
                for text, ids in zip(texts, encoded, strict=True):
                    listed = ids.tolist()
                    split = own.offsets(ids, text.encode())[2] if listed else 0
                    digest = hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest()
                    rows.append((len(listed), digest, hashlib.sha256(own.decode(listed)).hexdigest(), split))
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([read.column(0), *columns], schema.names)

    return source.mapInArrow(run, schema)
